"""Beyond HOF_PAIRS pairs exact search multiplies blocks, with the same rows; below them it stays in the JVM."""

import numpy as np
import pytest

from tests.test_vectors import asked, rows, table
from vektorium.operators import search
from vektorium.plans import registry


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(2_100, 3)).astype(np.float32), rng.normal(size=(500, 3)).astype(np.float32)
    return x, q, table(spark, x).repartition(3).cache(), asked(spark, q).cache()


def in_blocks(df) -> bool:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "MapInArrow" in plan and "NestedLoopJoin" not in plan and "Cartesian" not in plan


def test_many_pairs_by_dot(spark, many):
    x, q, base, queries = many
    got = search.exact_search(base, queries, 3, "dot")
    assert in_blocks(got) and not in_blocks(search.exact_search(base, queries.where("query_id < 9"), 3, "dot"))
    want = np.argsort(-(q.astype(np.float64) @ x.T.astype(np.float64)), axis=1, kind="stable")[:, :3]
    assert [r[2] for r in rows(got)] == want.ravel().tolist()


def test_many_pairs_by_distance(spark, many):
    x, q, base, queries = many
    got = search.exact_search(base, queries, 3, "l2", digits=9)
    assert in_blocks(got)
    d = ((x.astype(np.float64)[None] - q.astype(np.float64)[:, None]) ** 2).sum(axis=2).round(9)
    assert [r[2] for r in rows(got)] == np.argsort(d, axis=1, kind="stable")[:, :3].ravel().tolist()


@pytest.mark.parametrize("pairs", [0, 1 << 40])
def test_rounded_distances_tie(spark, tmp_path, monkeypatch, pairs):
    """As in the SQL: distances equal to 9 digits are ordered by id."""
    monkeypatch.setattr(search, "HOF_PAIRS", pairs)
    table(spark, [[0.0, 0.0], [1.0, 2e-5], [1.0, 1e-5], [1.0, 0.0], [3.0, 0.0]]).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [r[2] for r in rows(registry.queries()["exact_topk_l2"](spark, str(tmp_path)))] == [0, 1, 2, 3, 4]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """250 queries and 5,000 rows of embeddings."""
    place = str(tmp_path_factory.mktemp("many"))
    table(spark, np.random.default_rng(6).normal(size=(5_000, 4)).astype(np.float32)).write.parquet(f"{place}/embeddings.parquet")
    return place


@pytest.mark.parametrize("name", ["int8_refine", "int8_topk_dot", "recall_hits", "recall_int8"])
def test_queries_of_many_pairs(spark, folder, name, monkeypatch):
    got = registry.queries()[name](spark, folder)
    assert in_blocks(got)
    in_order = lambda df: sorted(map(tuple, df.collect()))
    monkeypatch.setattr(search, "HOF_PAIRS", 1 << 40)
    assert in_order(got) == in_order(registry.queries()[name](spark, folder))
