"""Mixing, BPE, license scans, language ID, the pipeline."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import data
from vektorium.llm import bpe, langid, license_scan, mixing

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def targets(sizes, share=1.5, epochs=2.0, weights=(3, 1, 2)):
    """Water-filling by repetition: what is above its stop is cut and the rest is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if w[s] * level > epochs * sizes[s]]
        if not over:
            out |= {s: w[s] * level for s in open_}
            break
        for s in over:
            out[s] = epochs * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


@pytest.mark.parametrize("slice_", [5000, 3])
def test_mixing(spark, sf_dir, slice_, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", slice_)
    for df in (data.real(spark, sf_dir), data.docs(spark)):
        rows = [(r["doc_id"], r["source"], len(data.words(r["text"]))) for r in df.collect()]
        sizes = {}
        for _, s, n in rows:
            sizes[s] = sizes.get(s, 0) + n
        want = targets(sizes)
        got = mixing.plan(df).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((i is None, i or 0, n) for i, _, n in rows)
        source = {(i, n): s for i, s, n in rows}
        taken = {}
        for r in got:
            s = source[r["doc_id"], r["size"]]
            assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
            taken[s] = taken.get(s, 0) + r["taken"]
        for s in sizes:
            assert abs(taken[s] - want[s]) <= max((n for _, x, n in rows if x == s), default=0) / 2 + 1e-6
        again = mixing.plan(df.repartition(2)).collect()
        assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_mixed_rows(spark):
    df = data.docs(spark)
    out, copies = mixing.mixed(df), {}
    for r in mixing.plan(df).collect():  # rows that share a doc_id are taken one by one
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + r["copies"]
    assert out.columns == df.columns
    n = {}
    for r in out.collect():
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + 1
    assert all(n.get(i, 0) == c for i, c in copies.items())
    assert mixing.plan(data.empty(spark)).count() == 0 and mixing.mixed(data.empty(spark)).count() == 0


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(open(PATH, "rb").read(), public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" \n\t\x85 \x1c'stabé漢😀0́.", max_size=80))
def test_bpe_equals_library(library, coder, text):
    ids = coder.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert coder.decode(ids) == text.encode()


def test_bpe_long_texts(library, coder):
    for text in ("ab" * 3000, "é" * 2000, " " * 1000 + "x", data.LONG * 3, "<|endoftext|> x", "\n \n" * 500):
        ids = b"".join(coder._slice(x) for x in coder.slices(text))
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text) and coder.decode(ids) == text.encode()


def test_bpe_rows(spark, sf_dir, library):
    for df in (data.real(spark, sf_dir), data.docs(spark)):
        want = []
        for r in df.collect():
            ids = library.encode_ordinary(r["text"] or "")
            want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
        got = bpe.digests(df, PATH, public_tokenizers.PATTERN)
        assert data.kept(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    out = bpe.encode(data.docs(spark), PATH, public_tokenizers.PATTERN)
    assert out.columns == data.docs(spark).columns and dict(out.dtypes)["ids"] == "binary"  # a column of that name is replaced
    assert bpe.digests(data.empty(spark), PATH, public_tokenizers.PATTERN).count() == 0


def test_bpe_short_pieces_together(library, coder, monkeypatch):
    one_by_one, merge = [], bpe.merge
    monkeypatch.setattr(bpe, "merge", lambda piece, ranks: one_by_one.append(piece) or merge(piece, ranks))
    rnd = random.Random(5)
    words = ["".join(rnd.choices("etaoinshrdluéß漢😀.,'9\n\x85", k=rnd.randint(1, 14))) for _ in range(5000)]
    texts = [" ".join(rnd.choices(words, k=60)) for _ in range(100)] + ["".join(rnd.choices("etaoin", k=n)) for n in (32, 33, 34, 1025, 1060, 3000)]
    assert [np.frombuffer(coder.encode(x), "<u4").tolist() for x in texts] == [library.encode_ordinary(x) for x in texts]
    assert all(x in coder.ranks or len(x) > 32 for x in one_by_one)  # new words don't take a merge in Python each


@pytest.mark.parametrize("cache, group, rows", [(2, 1, 1), (40, 200, 7), (300_000, 1 << 19, 1 << 13)])
def test_bpe_groups(library, monkeypatch, cache, group, rows):
    for name, value in (("CACHE", cache), ("GROUP", group), ("ROWS", rows), ("SLICE", 50)):
        monkeypatch.setattr(bpe, name, value)
    c, rnd = bpe.Coder(open(PATH, "rb").read(), public_tokenizers.PATTERN), random.Random(6)
    texts = ["".join(rnd.choices([" ", "  ", " \n", "\t", "word", "zqx", "Ünï", "'s", "12", ", ", "x" * 120], k=rnd.randint(0, 80))) for _ in range(150)]
    for _ in range(2):
        assert [np.frombuffer(b"".join(x), "<u4").tolist() for x in c.coded(texts)] == [library.encode_ordinary(x) for x in texts]
    assert list(c.coded([])) == [] and len(c.old) + len(c.new) <= cache + 1000


def test_bpe_other_vocabularies():
    ranks = b"\n".join(base64.b64encode(x) + b" %d" % i for i, x in enumerate([b"a", b"b", b"c", b"ab", b"abc"]))
    c = bpe.Coder(ranks, r"\p{L}+")  # not every byte, and a pattern that leaves characters out
    assert np.frombuffer(c.encode("abc, ab  abab cb"), "<u4").tolist() == [4, 3, 3, 3, 2, 1]


def test_licenses(spark):
    out = {r["doc_id"]: r for r in license_scan.scan(data.docs(spark)).collect() if r["doc_id"] is not None}
    r = out[12]
    assert (r["n_base"], r["first_word"], r["base_labels"]) == (5, 3, "apache,cc-by,gpl,mit") and "mit" in r["labels"] and 0.8 <= r["score"] <= 1
    assert out[0]["n_words"] == 0 and out[0]["first_word"] is None and out[0]["labels"] == "" and out[0]["score"] == 0
    assert out[4]["n_base"] == 0 and license_scan.scan(data.docs(spark)).count() == len(data.rows())
    assert license_scan.scan(data.empty(spark)).count() == 0
    edge = [(1, "mit  LICENSE"), (2, "mit licenses"), (3, "éMIT license"), (4, "cc-by x\ncc\nby"), (5, "Licensed under the Apache License, Version 2.0")]
    got = {r["doc_id"]: (r["n_base"], r["labels"]) for r in license_scan.scan(spark.createDataFrame(edge, "doc_id long, text string")).collect()}
    assert got == {1: (1, "mit"), 2: (0, ""), 3: (0, ""), 4: (2, "cc-by"), 5: (1, "apache,apache-2.0")}


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""
BSD = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions
# are met:"""
APACHE = "Licensed under the Apache\n   License, Version 2.0 (the License);"
GPL = """This program is free software: you can redistribute it and/or modify
  it under the terms of the GNU General Public License as published by
  the Free Software Foundation, either version 3 of the License"""


def brute_labels(text, threshold=0.8):
    """Every run of as many words as a notice has, by sets."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    labels, score = set(), 0.0
    for label, notice in license_scan.NOTICES:
        m, tokens = len(notice.split()), set(notice.split())
        c = max((len(tokens & set(w[i : i + m])) / len(tokens) for i in range(len(w))), default=0)
        if c >= threshold - 1e-9:
            labels.add(label)
            score = max(score, c)
    return labels, score


def test_wrapped_notices(spark):
    rng, vocabulary = random.Random(8), sorted({t for _, n in license_scan.NOTICES for t in n.split()}) + ["alpha", "beta"]
    filler = " ".join(rng.choice(["alpha", "beta", "the", "of"]) for _ in range(300))
    texts = [MIT, BSD, APACHE, GPL, f"{filler}\n{MIT}\n{filler} {GPL}", filler, "mozilla " * 500, " ".join(MIT.split()[::2]), None, ""]
    for _ in range(60):  # notices with words lost and put between, in random company
        _, notice = rng.choice(license_scan.NOTICES)
        own = [t for t in notice.split() if rng.random() > 0.12]
        for _ in range(rng.randrange(4)):
            own.insert(rng.randrange(len(own) + 1), rng.choice(vocabulary))
        texts.append("\n".join([filler[: rng.randrange(200)], " \n".join(own), " ".join(rng.choice(vocabulary) for _ in range(40))]))
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        labels, score = brute_labels(text)
        assert set(filter(None, got[i]["labels"].split(","))) == labels | set(filter(None, got[i]["base_labels"].split(","))), text
        assert abs(got[i]["score"] - score) < 1e-12
    assert [got[i]["labels"] for i in range(4)] == ["mit", "bsd", "apache,apache-2.0", "gpl"] and got[5]["labels"] == got[6]["labels"] == ""


def test_language_accuracy(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs, per_label=80)
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(got) > 100 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    for r in langid.predict(docs, model).select("doc_id", "held_out").limit(50).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert model["weights"].size and (model["weights"] == 0).mean() > 0.3  # sparse


def plain_model(rows, per_label, epochs=4, seed=7, alpha=0.5, beta=1.0, l1=0.02, l2=0.05):
    """Language ID a second time, by dictionaries and loops: rows of (hash, text, lang) that may be learned from."""
    mask = (1 << 64) - 1

    def grams(text):
        cp, c = [ord(x) for x in text.lower()], {}
        for n in (1, 2, 3):
            for i in range(len(cp) - n + 1):
                g = 0
                for x in cp[i : i + n]:
                    g = (g * 0x9E3779B97F4A7C15 + x) & mask if n > 1 else x
                h = (g * 0xBF58476D1CE4E5B9 + n) & mask
                k = ((h ^ h >> 29) * 0x94D049BB133111EB & mask) >> 50
                c[k] = c.get(k, 0) + 1
        return c

    df = {}
    for _, text, _ in rows:
        for k in grams(text):
            df[k] = df.get(k, 0) + 1
    idf = lambda k: math.log((1 + len(rows)) / (1 + df.get(k, 0))) + 1
    by_lang, picked = {}, []
    for h, text, lang in sorted(set(rows)):
        by_lang.setdefault(lang, []).append((h, text, lang))
    for own in by_lang.values():
        picked += own[:per_label]
    labels, examples = sorted(by_lang), []
    for h, text, lang in sorted(picked, key=lambda r: (r[0], r[2])):
        v = {k: (1 + math.log(n)) * idf(k) for k, n in grams(text).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        examples.append(({k: x / size for k, x in v.items()} | {1 << 14: 1.0}, labels.index(lang)))
    rng = np.random.default_rng(seed)
    rng.shuffle(examples)
    held, z, n = examples[: len(examples) // 5], {}, {}

    def weight(k, y):
        zz, nn = z.get((k, y), 0.0), n.get((k, y), 0.0)
        return 0.0 if abs(zz) <= l1 else -(zz - math.copysign(l1, zz)) / ((beta + math.sqrt(nn)) / alpha + l2)

    logits = lambda v: [sum(x * weight(k, y) for k, x in v.items()) for y in range(len(labels))]

    def soft(a):
        e = [math.exp(x - max(a)) for x in a]
        return [x / sum(e) for x in e]

    learn = examples[len(held) :] or examples
    for _ in range(epochs):
        for at in rng.permutation(len(learn)):
            v, label = learn[at]
            p = soft(logits(v))
            for k, x in v.items():
                for y in range(len(labels)):
                    g, old, w = x * (p[y] - (y == label)), n.get((k, y), 0.0), weight(k, y)
                    z[k, y] = z.get((k, y), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w
                    n[k, y] = old + g * g
    grid = [math.exp(math.log(0.02) + (math.log(10) - math.log(0.02)) * i / 119) for i in range(120)]
    loss = [sum(-math.log(soft([a / t for a in logits(v)])[y] + 1e-12) for v, y in held) for t in grid]
    t = grid[loss.index(min(loss))] if held else 1.0

    def predict(text):
        v = {k: (1 + math.log(n)) * idf(k) for k, n in grams(text).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        p = soft([a / t for a in logits({k: x / size for k, x in v.items()} | {1 << 14: 1.0})])
        return labels[p.index(max(p))], max(p)

    return t, predict


def test_language_by_loops(spark):
    texts = ["the cat sat on the mat", "the dog and the cat", "a man and the sea", "der Hund und die Katze", "die Frau und das Meer", "ein Mann und der See", "le chat et le chien", "la mer et le soleil", "un homme et la mer"]
    rows = [(i, f"{texts[i % 9]} {i * 7 % 11} {texts[(i * 5 + 3) % 9 // 3 * 3 + i % 3] if i % 4 else ''}", ["en", "de", "fr"][i % 9 // 3]) for i in range(60)]
    rows += [rows[1], rows[1], (7, "noch ein Text mit der Nummer von oben", "de"), (None, "encore un texte", "fr"), (70, None, "en"), (71, "not labelled", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.train(df, per_label=8)
    usable = df.where("text IS NOT NULL AND lang IS NOT NULL AND pmod(crc32(cast(coalesce(cast(doc_id AS string), '') AS binary)), 5) <> 0")
    hashed = [tuple(r) for r in usable.selectExpr("xxhash64(doc_id, text, 7)", "text", "lang").collect()]
    t, predict = plain_model(hashed, 8)
    assert abs(model["temperature"] - t) < 1e-9 and model["labels"] == ["de", "en", "fr"]
    for _, text, _ in rows:
        if text:
            label, p = predict(text)
            got = langid.score(text, model)
            assert got[0] == label and abs(got[1] - p) < 1e-9
    again = langid.train(df.repartition(5), per_label=8)
    assert (again["weights"] == model["weights"]).all()


def test_language_sample(spark):
    hashes = spark.range(3000).selectExpr("if(id % 3 = 0, 'a', 'b') AS lang", "xxhash64(id) AS h").union(spark.createDataFrame([("c", 5)] * 50, "lang string, h long"))
    every = {}
    for r in hashes.distinct().collect():
        every.setdefault(r["lang"], []).append(r["h"])
    assert langid._sample(hashes, 5) == sorted((lang, x) for lang, h in every.items() for x in sorted(h)[:5])


def test_too_many_labels(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LABELS", 2)
    with pytest.raises(ValueError):
        langid._sample(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "lang string, h long"), 5)


def test_language_edges(spark):
    model = langid.train(data.docs(spark))
    out = {r["doc_id"]: r for r in langid.predict(data.docs(spark), model).collect()}
    assert {i for i, r in out.items() if r["lang_pred"] == "und"} == {0, 1, 2, 11} and out[9]["lang_pred"] == "en"
    stay = langid.accepted(data.docs(spark), model)
    assert stay.columns == data.docs(spark).columns and stay.where("doc_id IN (0, 1, 2, 11)").count() == 0
    assert langid.train(data.empty(spark)) is None
    assert langid.predict(data.docs(spark), None).where("lang_pred <> 'und' OR score <> 0").count() == 0
    assert langid.predict(data.empty(spark), model).count() == 0
    assert {r["doc_id"] for r in langid.accepted(data.docs(spark), None).collect()} == set(range(len(data.TEXTS))) - {0, 1, 2, 11} | {None}


def test_pipeline(spark, sf_dir, library):
    """Each stage against what its own input asks for."""
    docs = data.real(spark, sf_dir)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash", "mixing", "bpe"]
    stages, before = dict(corpus_pipeline.STAGES), docs
    held = {}
    for name in names:
        before = stages[name](spark, before, sf_dir).cache()
        held[name] = before
        if name != "bpe":
            assert before.columns == docs.columns
    clean = docs.where("lang IS NOT NULL AND length(text) > 200")
    assert held["language_id"].join(clean, "doc_id", "left_semi").count() >= 0.98 * clean.count()
    assert held["line_dedup"].count() == held["language_id"].count()
    assert 0 < held["simhash"].count() < held["line_dedup"].count()
    texts = {r["doc_id"]: r["text"] for r in held["mixing"].collect()}
    for r in held["bpe"].collect():
        assert list(r["ids"] or []) == library.encode_ordinary(texts[r["doc_id"]] or "")
    assert held["bpe"].count() == held["mixing"].count()
    assert corpus_pipeline.run(spark, sf_dir).count() == held["bpe"].count()


def test_pipeline_edges(spark, library):
    """Nulls, empty and long texts, repeated rows, clashing names, no labels, no rows."""
    stages = dict(corpus_pipeline.STAGES)
    for docs in (data.docs(spark), data.docs(spark).withColumn("lang", F.lit(None).cast("string")), data.empty(spark)):
        seen, before = {}, docs
        for name, stage in corpus_pipeline.STAGES:
            before = stage(spark, before, "").cache()
            seen[name] = before
            assert name == "bpe" or before.columns == docs.columns
        n = {name: df.count() for name, df in seen.items()}
        if not docs.count():
            assert set(n.values()) == {0}
            continue
        ids = {r["doc_id"] for r in seen["language_id"].collect()}
        assert {3, 4, 7, 8, 9, 12, 13} <= ids and not ids & {0, 1, 2, 11}
        assert n["line_dedup"] == n["language_id"] and n["bpe"] == n["mixing"]
        assert seen["line_dedup"].where("n_chars <> length(text) OR isnull(n_chars) <> isnull(text)").count() == 0
        stay = [r["doc_id"] for r in seen["simhash"].collect()]
        assert len(set(stay)) == len(stay) and {3, 7, 9, None} <= set(stay) and 10 not in stay
        for r in seen["bpe"].collect():
            texts = {x["text"] for x in seen["mixing"].collect() if x["doc_id"] == r["doc_id"]}
            assert list(r["ids"] or []) in [library.encode_ordinary(t or "") for t in texts]
    loose = spark.createDataFrame([r[:5] for r in data.rows()], "doc_id long, text string, lang string, source string, n_chars long")
    rows = loose.collect()
    copies = {}
    for r in stages["mixing"](spark, loose, "").collect():
        copies[r] = copies.get(r, 0) + 1
    planned = sum(r["copies"] for r in mixing.plan(loose).collect())
    assert sum(copies.values()) == planned and set(copies) <= set(rows)
