"""LM scores, substring dedup, line dedup: against SQL or brute force, with edges."""

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests import oracle
from tests.llm import data
from vektorium.llm import kernels, line_dedup, lm_score, packs, queries, substring_dedup


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sf_dir, name):
    got = oracle.spark_rows(queries.queries()[name](spark, sf_dir))
    assert got[1] and oracle.mismatch(got, oracle.sql_rows(oracle.connect(sf_dir), queries.oracle_sql()[name])) == ""


def brute_scores(rows, least, order=3, alpha=0.4):
    texts = [data.words(t) for _, t in rows]
    c = Counter(tuple(w[i - n + 1 : i + 1]) for w in texts for n in range(1, order + 1) for i in range(n - 1, len(w)))
    total, out = sum(len(w) for w in texts), []
    for (ident, _), w in zip(rows, texts):
        s = 0.0
        for i in range(len(w)):
            top = min(order, i + 1)
            n = next((n for n in range(top, 1, -1) if c[tuple(w[i - n + 1 : i + 1])] >= least), 1)
            s += (top - n) * math.log(alpha) + math.log(c[tuple(w[i - n + 1 : i + 1])] / (c[tuple(w[i - n + 1 : i])] if n > 1 else total))
        shared = sum(c[tuple(w[max(0, i - order + 1) : i + 1])] > 1 for i in range(len(w)))
        out.append((ident, len(w), shared, round(s, 4)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("pack,least", [(1 << 23, 1), (1 << 16, 1), (1 << 16, 2), (1 << 16, 3)])
def test_scores(spark, pack, least):
    got = lm_score.stupid_backoff(data.docs(spark), min_count=least, pack_bytes=pack).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_elsewhere"], round(r["score"], 4)) for r in got), key=repr) == brute_scores([r[:2] for r in data.rows()], least)
    assert all((r["mean_score"] is None) == (r["n_words"] == 0) for r in got)


def brute_substrings(rows, width):
    texts = [data.words(t) for _, t in rows]
    c = Counter(tuple(w[i : i + width]) for w in texts for i in range(len(w) - width + 1))
    out = []
    for (ident, _), w in zip(rows, texts):
        gone = set()
        for i in range(len(w) - width + 1):
            if c[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((ident, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width,pack", [(35, 1 << 23), (35, 1 << 16), (3, 1 << 23), (13, 1 << 23)])
def test_substrings(spark, width, pack):
    df = substring_dedup.removed_words(data.docs(spark).select("doc_id", "text"), width, pack, substring_dedup._digest, substring_dedup.RESULT)
    assert data.kept(df, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings([r[:2] for r in data.rows()], width)


def test_substring_texts(spark):
    got = {r["doc_id"]: r["kept_text"] for r in substring_dedup.dedup(data.docs(spark)).collect()}
    assert got[7] == "before it after it" and got[8] == "something else" and got[0] == ""


def brute_lines(rows, threshold=0.8):
    """rows in the order of their ids."""
    seen, out = [], []
    for ident, text in rows:
        keep, lines = [], (text or "").split("\n")
        for x in lines:
            s = set(data.words(x))
            if not (s and any(len(s & o) / len(s | o) >= threshold - 1e-12 for o in seen)):
                keep.append(x)
            if s:
                seen.append(s)
        out.append((ident, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("nearest,pack,block", [(4, 1 << 23, 1 << 13), (1, 1 << 15, 1 << 13), (1, 1 << 23, 2), (4, 1 << 15, 3)])
def test_lines(spark, sf_dir, nearest, pack, block, monkeypatch):
    df = data.real(spark, sf_dir)
    want = brute_lines([(r["doc_id"], r["text"]) for r in df.orderBy("doc_id").collect()])
    monkeypatch.setattr(line_dedup, "NEAREST", nearest)
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    assert data.kept(line_dedup.digests(df, pack_bytes=pack), "doc_id", "n_lines", "n_removed", "kept_sha256") == want
    assert sum(r[2] for r in want) > 0


@pytest.mark.parametrize("nearest,block", [(4, 1 << 13), (1, 16), (1, 3)])
def test_templated_lines(spark, nearest, block, monkeypatch):
    """Lines of one template share their frequent words: long posting lists, and a second round."""
    rng = np.random.default_rng(3)
    line = lambda: " ".join([f"part{rng.integers(0, 60)}" for _ in range(4)] + "posted by the admin on this page today".split()[: rng.integers(5, 9)])
    rows = [(i, "\n".join(line() for _ in range(6))) for i in range(150)]
    monkeypatch.setattr(line_dedup, "NEAREST", nearest)
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    seen, second = [], line_dedup._second_round
    monkeypatch.setattr(line_dedup, "_second_round", lambda *a: seen.append(second(*a)) or seen[0])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_lines(rows)
    assert data.kept(line_dedup.digests(df, pack_bytes=1 << 13), "doc_id", "n_lines", "n_removed", "kept_sha256") == want
    assert sum(r[2] for r in want) > 10 and len(seen) == 1


def test_second_round_removes(spark, monkeypatch):
    """Parity bits of the farther line may cancel out; then the nearer one is found in the second round only."""
    rows = []
    for g in range(200):
        core = [f"core{g}x{i}" for i in range(17)]
        rows += [(3 * g + k, " ".join([*core, f"own{g}x{k}", f"also{g}x{k}", "of" if k == 0 else "the"])) for k in range(3)]
    monkeypatch.setattr(line_dedup, "NEAREST", 1)
    seen, second = [], line_dedup._second_round
    monkeypatch.setattr(line_dedup, "_second_round", lambda *a: seen.append(second(*a)) or seen[0])
    want = brute_lines(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert data.kept(line_dedup.digests(df, pack_bytes=1 << 13), "doc_id", "n_lines", "n_removed", "kept_sha256") == want
    assert sum(r[2] for r in want) == 200 and seen[0].count() > 0


def test_lines_with_edges(spark):
    got = line_dedup.dedup(data.docs(spark))
    assert got.columns == data.docs(spark).columns
    have = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)
    assert len(have) == len(data.rows())
    by = dict(have)
    assert by[0] is None and by[1] == "" and by[2] == data.TEXTS[2]
    assert by[7] == data.TEXTS[7] and by[8] == ""  # both lines of 8 have all but a few words of the line of 7
    assert line_dedup.dedup(data.empty(spark)).count() == 0
    long = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(500))), (2, " ".join(f"a{i}" for i in range(450))), (3, " ".join(f"a{i}" for i in range(300)))], "doc_id long, text string")
    assert [r[2] for r in data.kept(line_dedup.digests(long), "doc_id", "n_lines", "n_removed")] == [0, 1, 0]


@pytest.mark.parametrize("bits", [1, 2])
def test_more_packs_than_ranges(spark, sf_dir, bits, monkeypatch):
    """The exchange in several levels gives what one level gives."""
    monkeypatch.setattr(packs, "BITS", bits)
    df = data.real(spark, sf_dir)
    rows = [(r["doc_id"], r["text"]) for r in df.orderBy("doc_id").collect()]
    got = lm_score.stupid_backoff(df, pack_bytes=1 << 15).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_elsewhere"], round(r["score"], 4)) for r in got), key=repr) == brute_scores(rows, 1)
    gone = substring_dedup.removed_words(df.select("doc_id", "text"), 35, 1 << 15, substring_dedup._digest, substring_dedup.RESULT)
    assert data.kept(gone, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(rows, 35)
    made = packs.make_packs(df.select("doc_id", "text"), 1 << 15)
    assert made.count() > 1 << bits + 1
    lines = line_dedup.removed_lines(made, 1, bits=bits).count()
    assert lines == sum(r[2] for r in brute_lines(rows))


def test_rows_of_the_exchange_grow_with_packs(spark, sf_dir):
    df = data.real(spark, sf_dir).select("doc_id", "text")
    for size in (1 << 18, 1 << 15):
        made = packs.make_packs(df, size)
        shape = packs.shape_for(made)
        n = made.count()

        def count(pack, t, _, shape=shape):
            u, c = np.unique(lm_score._ordered(t)[0], return_counts=True)
            return packs.asked(packs.ask(pack, 0, u, c, shape))

        assert packs.each_pack(made, count, packs.ASKED).count() <= n << packs.BITS


def test_ids_are_dealt_evenly(spark):
    x = np.array([0, 1, -1, 1 << 40, -(1 << 62), 123456789], np.int64)
    df = spark.createDataFrame([(int(v),) for v in x], "v long")
    assert [r[0] for r in df.selectExpr("hash(v)").collect()] == packs.murmur(x).tolist()
    ids = [packs.even_id(k, k % 7, 7) for k in range(70)]
    parts = spark.createDataFrame([(v,) for v in ids], "v long").repartition(7, "v").selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    assert len(set(ids)) == 70 and sorted(r["count"] for r in parts) == [10] * 7


def test_lookup():
    rng = np.random.default_rng(6)
    for n in (1, 2, 1000):
        u = np.unique(rng.integers(0, 1 << 40, n).astype(np.uint64))
        x = rng.choice(u, 500)
        assert kernels.lookup(u, x, 40).tolist() == np.searchsorted(u, x).tolist()
    edge = np.array([0, 1, (1 << 40) - 1], np.uint64)
    assert kernels.lookup(edge, edge, 40).tolist() == [0, 1, 2] and len(kernels.lookup(edge[:0], edge[:0], 40)) == 0


def test_very_many_lines(monkeypatch):
    """Line numbers of any size stay apart from the words beside them."""
    t = pa.table({"c0": [1, 2], "c1": ["a b c\nd e\n\na", "b a b\nx"]})
    want = line_dedup._Lines(t, 1)
    monkeypatch.setattr(line_dedup, "_MOST_LINES", 2)
    got = line_dedup._Lines(t, 1)
    for name in ("line", "tok", "len", "at"):
        assert getattr(want, name).tolist() == getattr(got, name).tolist()
    assert want.sums().tolist() == got.sums().tolist()
    big = 1 << 24
    line, tok = line_dedup._sorted_pairs(np.array([big, 0, big]), np.array([5, 7, 3], np.uint64), big + 1)
    assert line.tolist() == [0, big, big] and tok.tolist() == [7, 3, 5]


def test_empty_tables(spark):
    assert lm_score.stupid_backoff(data.empty(spark)).count() == 0
    assert substring_dedup.dedup(data.empty(spark)).count() == 0
