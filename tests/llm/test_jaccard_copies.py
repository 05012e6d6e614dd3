"""The pipeline's near-copy stage: planted copies at shingle Jaccard 0.8 to 0.95 against brute force."""

import random

import corpus_pipeline
from tests.llm import data


def shingles(text, n=5):
    w = data.words(text.lower() if text else text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def planted(seed=6):
    """(doc_id, text): originals of 30 to 600 words, each with copies in which words are replaced."""
    rng, rows = random.Random(seed), []
    for k in range(120):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((30, 100, 300, 600)))]
        rows.append(w)
        for _ in range(3):
            c = list(w)
            for at in rng.sample(range(len(c)), max(1, round(len(c) * rng.uniform(0.002, 0.03)))):
                c[at] = f"x{rng.randrange(10**9)}"
            rows.append(c)
    texts = [" ".join(w) for w in rows] + ["", None, " \n", "one two", "ONE two", "one two three"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_planted_copies(spark, sf_dir):
    rows = planted()
    sets = [shingles(t) for _, t in rows]

    def jaccard(a, b):
        return len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] or sets[b] else 1.0

    hard = [(a, b) for a in range(len(rows)) for b in range(a) if 0.8 <= jaccard(a, b) <= 0.95]
    assert len(hard) > 100
    want = data.components([i for i, _ in rows], lambda a, b: jaccard(a, b) >= 0.8)
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").repartition(4)
    stay = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, sf_dir).collect()}
    gone = [i for i, c in enumerate(want) if c != i]
    assert not set(want) - stay  # nothing goes without a verified link
    assert len(set(gone) - stay) >= 0.98 * len(gone)


def test_components_equal_brute_force(spark):
    from vektorium.llm import simhash_jaccard

    rows = planted(7)
    sets = [shingles(t) for _, t in rows]
    near = lambda a, b: sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    want = data.components([i for i, _ in rows], near)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = dict(data.kept(simhash_jaccard.near_copies(df), "doc_id", "component_id"))
    wrong = [i for i in got if got[i] != want[i]]
    assert len(wrong) <= 0.02 * len(rows)
