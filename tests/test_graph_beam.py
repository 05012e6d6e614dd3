"""A graph keeps the beam that its rows need, so that the share found does not fall with the number of rows."""

import numpy as np
import pytest

from tests.test_vectors import rows, table
from vektorium.operators import evaluate, search
from vektorium.operators.index import HnswIndex


@pytest.fixture(scope="module")
def hard(spark):
    """Rows without structure, the hardest ones, with exact neighbours of some."""
    x = np.random.default_rng(8).normal(size=(3_000, 24)).astype(np.float32)
    base = table(spark, x).cache()
    q = base.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS q")
    return base, q, search.exact_search(base, q, 10, "l2", kernel="numpy").cache()


@pytest.mark.parametrize("shard_rows", [3_000, 800])
def test_a_narrow_beam_is_widened(spark, hard, shard_rows):
    base, q, truth = hard
    got = HnswIndex.build(base, 4, 20, shard_rows).search(q, 10, 10)
    assert evaluate.mean_recall(got, truth, 10).first()["recall"] >= 0.9


def test_a_saved_graph_keeps_its_beam(spark, hard, tmp_path):
    base, q, truth = hard
    index = HnswIndex.build(base, 4, 20)
    index.save(f"{tmp_path}/g")
    got = HnswIndex.load(spark, f"{tmp_path}/g").search(q, 10, 10)
    assert rows(got) == rows(index.search(q, 10, 10)) and evaluate.mean_recall(got, truth, 10).first()["recall"] >= 0.9
    spark.read.parquet(f"{tmp_path}/g").drop("ef").write.parquet(f"{tmp_path}/old")  # as written before
    assert HnswIndex.load(spark, f"{tmp_path}/old").search(q, 10, 10).count() == 1_500
