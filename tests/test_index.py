"""Indexes: limits at which they are exact, recall floors, saving, determinism."""

import numpy as np
import pytest

from tests.test_vectors import asked, rows, table
from vektorium.operators import evaluate, search
from vektorium.operators.index import HnswIndex, IvfIndex, IvfPqIndex, pq
from vektorium.operators.index.kmeans import lloyd, local_kmeans
from vektorium.streaming.append import append_to_ivf, with_stream


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    return x, table(spark, x).repartition(4).cache(), asked(spark, x[:12])


def recall(got, truth, k=10):
    return evaluate.mean_recall(got, truth, k).first()["recall"]


def test_ivf_with_all_lists_is_exact(spark, data, tmp_path):
    x, base, q = data
    index = IvfIndex.build(base, 8, None, 3)
    exact = search.exact_search(base, q, 10, "l2")
    assert rows(index.search(q, 10, 8)) == rows(exact)
    assert rows(index.search(q, 10, 8, "dot")) == rows(search.exact_search(base, q, 10, "dot"))
    r = [recall(index.search(q, 10, n), exact) for n in (1, 2, 4, 8)]
    assert r == sorted(r) and r[-1] == 1
    assert sum(s["n"] for s in index.list_sizes().collect()) == 400
    index.save(str(tmp_path / "ivf"))
    assert rows(IvfIndex.load(spark, str(tmp_path / "ivf")).search(q, 10, 2)) == rows(index.search(q, 10, 2))


def test_stream_appends_once(spark, data, tmp_path):
    x, base, q = data
    path, src = str(tmp_path / "ivf"), str(tmp_path / "src")
    full = IvfIndex.build(base, 8, None, 2)
    IvfIndex(full.centroids, full.lists.where("vec_id < 300")).save(path)
    base.where("vec_id >= 300").write.parquet(src)
    for _ in range(2):  # the second run finds nothing new
        append_to_ivf(spark.readStream.schema(base.schema).parquet(src), path, str(tmp_path / "state")).awaitTermination()
    got = with_stream(spark, path)
    assert got.lists.count() == 400
    assert rows(got.search(q, 10, 3)) == rows(full.search(q, 10, 3))


def test_kmeans(spark):
    base = table(spark, [[0, 0], [10, 10], [0, 1], [10, 11], [500, 500]])
    c = lloyd(base, 2, 3, train=4)
    assert c.tolist() == [[0, 0.5], [10, 10.5]]
    with pytest.raises(ValueError):
        lloyd(base, 9)
    x = np.array([[0.0], [0.0], [0.0], [9.0]])
    assert len(np.unique(local_kmeans(x, 2, 4))) == 2


def test_equidistant_lists_go_to_the_smaller_number(spark):
    index = IvfIndex(np.array([[1.0, 0.0], [-1.0, 0.0], [9.0, 9.0]]), table(spark, [[0, 0]]).selectExpr("vec_id", "embedding", "0 AS list_id"))
    assert len(rows(index.search(asked(spark, [[0, 5]]), 3, 1))) == 1  # list 0, not 1
    assert rows(index.search(asked(spark, [[9, 9]]), 3, 1)) == []  # an empty list


def test_product_quantization(spark, data, tmp_path):
    x, base, q = data
    books = pq.train_codebooks(x.astype(np.float64), 4, 4)
    codes = pq.encode(x, books)
    back = pq.decode(codes, books)
    assert np.allclose(pq.distances(x[0].astype(np.float64), codes, books), ((x[0] - back) ** 2).sum(1))
    with pytest.raises(ValueError):
        pq.train_codebooks(x.astype(np.float64), 3, 4)
    index = IvfPqIndex.build(base, 8, 4, 4)
    exact = search.exact_search(base, q, 10, "l2")
    assert rows(index.search(q, 10, 8, 400, base)) == rows(exact)
    r = [recall(index.search(q, 10, 8, n, base), exact) for n in (10, 40, 400)]
    assert r == sorted(r) and r[-1] == 1
    index.save(str(tmp_path / "pq"))
    assert rows(IvfPqIndex.load(spark, str(tmp_path / "pq")).search(q, 10, 4)) == rows(index.search(q, 10, 4))
    assert index.add(base.where("vec_id < 3")).lists.count() == 403


def test_learned_rotation(data):
    x = data[0].astype(np.float64) * np.linspace(0.2, 3, 16)[None, :]
    r = pq.learn_rotation(x, 4, 3, 6)
    assert np.allclose(r @ r.T, np.eye(16), atol=1e-9)

    def error(y):
        books = pq.train_codebooks(y, 4, 3, 4)
        return ((y - pq.decode(pq.encode(y, books), books)) ** 2).sum()

    assert error(x @ r.T) <= error(x) + 1e-9


def test_graph(spark, data, tmp_path):
    x, base, q = data
    exact = search.exact_search(base, q, 10, "l2")
    index = HnswIndex.build(base, 8, 64)
    assert recall(index.search(q, 10, 64), exact) >= 0.95
    assert recall(index.search(q, 10, 400), exact) >= recall(index.search(q, 10, 10), exact)
    split = HnswIndex.build(base, 8, 64, shard_rows=120)
    assert split.shards.count() > 1 and recall(split.search(q, 10, 64), exact) >= 0.95
    assert rows(split.search(q, 10, 32)) == rows(HnswIndex.build(base.repartition(7), 8, 64, shard_rows=120).search(q, 10, 32))
    index.save(str(tmp_path / "g"))
    assert rows(HnswIndex.load(spark, str(tmp_path / "g")).search(q, 5)) == rows(index.search(q, 5))
    with pytest.raises(ValueError):
        HnswIndex.build(base.limit(0))


def test_ground_truth_needs_k_rows(spark):
    base, q = table(spark, [[1, 2], [3, 4], [5, 6]]), asked(spark, [[1, 0]])
    with pytest.raises(ValueError):
        evaluate.build_ground_truth(base, q, 4)
    truth = evaluate.build_ground_truth(base, q, 3)
    assert recall(truth, truth, 3) == 1 and recall(truth.limit(0), truth, 3) == 0
