"""LM scores under all counts of the corpus, singletons included."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import data
from vektorium.llm import kernels, lm_score


def whole_scores(rows, order=3):
    texts = [data.words(t) for _, t in rows]
    c = Counter(tuple(w[i - n + 1 : i + 1]) for w in texts for n in range(1, order + 1) for i in range(n - 1, len(w)))
    total, out = sum(len(w) for w in texts), []
    for (ident, _), w in zip(rows, texts):
        s = 0.0
        for i in range(len(w)):
            n = min(order, i + 1)
            s += math.log(c[tuple(w[i - n + 1 : i + 1])] / (c[tuple(w[i - n + 1 : i])] if n > 1 else total))
        out.append((ident, len(w), len(w), round(s, 4)))
    return sorted(out, key=repr)


def test_singletons_are_counted(spark):
    got = lm_score.stupid_backoff(data.docs(spark), min_count=1, pack_bytes=1 << 16).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_full"], round(r["score"], 4)) for r in got), key=repr) == whole_scores([r[:2] for r in data.rows()])


def test_whole_hashes_are_sent(spark, monkeypatch):
    """All 64 bits of every distinct n-gram are sent."""
    sent = {n: [] for n in (1, 2, 3)}

    def catch(pack, kind, u, counts, shape):
        sent[kind].append(u)
        return []

    caught = []
    monkeypatch.setattr(lm_score, "ask", catch)
    monkeypatch.setattr(lm_score, "cut", lambda df: df)
    monkeypatch.setattr(lm_score, "answer", lambda df, shape: df)
    monkeypatch.setattr(lm_score, "each_pack", lambda packs, fn, *_: caught.append(fn) or spark.createDataFrame([], "words long"))
    lm_score.stupid_backoff(data.docs(spark))
    t = pa.table({"c0": [1], "c1": ["a b c a b d e"]})
    h, before, _ = lm_score._ordered(t)
    for n in (1, 2, 3):
        caught[n - 1](0, t, None)
        assert np.concatenate(sent[n]).tolist() == np.unique(lm_score._grams(h, before, n)[1]).tolist()
