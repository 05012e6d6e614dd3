"""Coded rows and nearest lists by products: the same as one query, or one row, at a time, and far fewer sums."""

import numpy as np
import pytest

from vektorium.functions import kernels
from vektorium.operators.index import pq, store


@pytest.mark.parametrize("digits", [None, 9])
@pytest.mark.parametrize("size", [1.0, 1e4])
def test_nearest_coded_is_what_all_distances_give(digits, size):
    rng = np.random.default_rng(2)
    books, q = rng.normal(size=(4, 8, 3)) * size, rng.normal(size=(33, 12)) * size
    books[:, 5] = books[:, 4]  # equal codewords: equal distances
    codes, ids = rng.integers(0, 8, (700, 4)).astype(np.int16), rng.permutation(700) + 5
    for k in (1, 10, 699, 2_000):
        got = [tuple(r.values()) for b in pq.nearest_coded(np.arange(33) * 7, q, ids, codes, books, k, digits) for r in b.to_pylist()]
        want = []
        for n, x in enumerate(q):
            dist = pq.distances(x, codes, books)
            dist = dist if digits is None else np.round(dist, digits)
            want += [(n * 7, int(ids[r]), float(dist[r])) for r in np.lexsort((ids, dist))[:k]]
        assert got == want


def test_far_rows_are_not_summed(monkeypatch):
    rng, summed = np.random.default_rng(3), []
    monkeypatch.setattr(pq, "distances", lambda q, codes, books: summed.append(len(codes)))
    list(pq.nearest_coded(np.arange(20), rng.normal(size=(20, 8)), np.arange(4_000), rng.integers(0, 16, (4_000, 4)).astype(np.int16), rng.normal(size=(4, 16, 2)), 10))
    assert sum(summed) == 0


def test_nearest_list_is_exact(monkeypatch):
    rng = np.random.default_rng(4)
    x, c = np.round(rng.normal(size=(3_000, 2)) * 3) / 2, np.array([[0.0, 0], [1, 0], [0, 1], [1, 1], [1, 1]])
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    looked = []
    monkeypatch.setattr(kernels, "block_topk", lambda m, a, b, n, f=kernels.block_topk: looked.append(len(b)) or f(m, a, b, n))
    lists, dist = store.nearest_lists(x, c, 1)
    assert lists[:, 0].tolist() == d.argmin(axis=1).tolist() and dist[:, 0].tolist() == d.min(axis=1).tolist()
    assert 0 < sum(looked) < 3_000  # only rows with ties
    assert store.nearest_lists(np.zeros((0, 2)), c, 1)[0].shape == (0, 1)


def test_training_looks_again_at_few_rows(monkeypatch):
    looked = []
    monkeypatch.setattr(kernels, "block_topk", lambda m, a, b, n, f=kernels.block_topk: looked.append(len(b)) or f(m, a, b, n))
    x = np.random.default_rng(5).normal(size=(2_000, 8))
    rotation = pq.learn_rotation(x, 4, 3, 2)
    assert np.allclose(rotation @ rotation.T, np.eye(8)) and sum(looked) < 200
