"""A run's batches don't grow in number with the queries, and what they send to the driver neither; all queries are timed."""

import numpy as np
import pytest

from tests.test_vectors import table
from vektorium.operators import programs
from vektorium.operators.index import IvfIndex


@pytest.fixture(scope="module")
def base(spark):
    return table(spark, np.random.default_rng(9).normal(size=(400, 8)).astype(np.float32)).cache()


@pytest.fixture(scope="module")
def queries(base):
    return base.where("vec_id % 4 = 0").selectExpr("vec_id AS query_id", "embedding AS q")


def test_batches_hold_every_query_once(queries):
    for batch in (1, 30, 1_000):
        parts = programs._batches(queries, batch)
        assert len(parts) == min(16, -(-100 // batch)) and sum(n for _, n in parts) == 100
        got = sorted(r["query_id"] for part, _ in parts for r in part.collect())
        assert got == list(range(0, 400, 4))


@pytest.mark.parametrize("mode,pipeline", [("full", "staged"), ("full", "interleaved"), ("ann_only", "staged")])
def test_evaluation(spark, base, queries, mode, pipeline):
    index, before = IvfIndex.build(base, 4, None, 2), spark.sparkContext._jsc.getPersistentRDDs().size()
    r = programs.evaluate(index, base, queries, 5, 4, 20, mode=mode, pipeline=pipeline, batch=2, warmup=0).first()
    assert (r["queries"], r["batches"], r["recall"]) == (100, 16, 1.0)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before + 1  # the lists only: no batch is kept


def test_packed_queries_are_not_broadcast(base, queries):
    plan = IvfIndex.build(base, 4, None, 2).search(queries, 5, 2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_bench(base, queries):
    r = programs.bench_exact(base, queries, 3, batch=2, warmup=0).first()
    assert (r["n"], r["batches"]) == (100, 16)
