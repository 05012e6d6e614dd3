"""Vector functions, typed storage and exact search on small tables with edges."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vektorium.functions import kernels, vector
from vektorium.operators import search, tables


def table(spark, x, ids=None):
    return spark.createDataFrame([(i, None if v is None else [float(c) for c in v]) for i, v in zip(ids or range(len(x)), x)], "vec_id long, embedding array<float>")


def asked(spark, q):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(q)], "query_id long, q array<float>")


def rows(df):
    return [tuple(r) for r in df.orderBy("query_id", "rank").collect()]


TIES = [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 1, 0, 0], [0.5, 0.5, 0, 0], [0, 1, 0, 0]]


@pytest.mark.parametrize("kernel", ["hof", "numpy"])
@pytest.mark.parametrize("metric", ["dot", "l2"])
def test_ties_go_to_the_smaller_id(spark, kernel, metric):
    for base in (table(spark, TIES), table(spark, TIES).repartition(5)):
        got = rows(search.exact_search(base, asked(spark, [[0, 1, 0, 0]]), 4, metric, kernel=kernel))
        assert [r[2] for r in got] == [1, 3, 5, 4]


@pytest.mark.parametrize("limit", [0, 1 << 26])
def test_kernels_agree_bit_for_bit(spark, limit):
    rng = np.random.default_rng(1)
    for d in (1, 7, 9, 15, 17, 33):
        base, q = table(spark, rng.normal(size=(60, d)).astype(np.float32)), asked(spark, rng.normal(size=(5, d)).astype(np.float32))
        for metric in ("dot", "l2"):
            a = rows(search.exact_search(base, q, 7, metric))
            assert rows(search.exact_search(base, q, 7, metric, kernel="numpy", broadcast_bytes=limit)) == a


def test_k_is_clamped_and_zero_is_empty(spark):
    base, q = table(spark, TIES[:3]), asked(spark, [[1, 2, 3, 4]])
    for kernel in ("hof", "numpy"):
        assert search.exact_search(base, q, 0, kernel=kernel).count() == 0
        assert search.exact_search(base, q, 10, kernel=kernel).count() == 3
        assert search.exact_search(base, q, 2_000, kernel=kernel).count() == 3


def test_errors(spark):
    base, q = table(spark, TIES), asked(spark, [[1, 2, 3]])
    with pytest.raises(ValueError, match="dimensions"):
        search.exact_search(base, q, 1)
    with pytest.raises(ValueError, match="no vectors"):
        search.exact_search(base.limit(0), q, 1)
    with pytest.raises(ValueError):
        search.exact_search(base, asked(spark, [[1, 2, 3, 4]]), 1, kernel="other")
    with pytest.raises(ValueError):
        tables.require_sound(table(spark, [[1, 2], [1, 2, 3]]))
    with pytest.raises(ValueError):
        tables.require_sound(table(spark, [[1, 2], None]))
    assert tables.require_sound(table(spark, TIES)) == 4


def test_no_number_is_never_ranked(spark):
    base = table(spark, [[1, 1], [math.nan, 1], [2, 2], [math.inf, -math.inf]])
    for kernel in ("hof", "numpy"):
        got = rows(search.exact_search(base, asked(spark, [[1, 1]]), 4, kernel=kernel))
        assert [r[2] for r in got] == [2, 0]
    bad = {r["vec_id"]: r["finite"] for r in tables.check_vectors(base).collect()}
    assert bad == {0: True, 1: False, 2: True, 3: False}


def test_metrics_differ_where_norms_do(spark):
    base, q = table(spark, [[10, 0], [0.9, 0.1]]), asked(spark, [[1, 0]])
    assert rows(search.exact_search(base, q, 1, "dot"))[0][2] == 0
    assert rows(search.exact_search(base, q, 1, "l2"))[0][2] == 1


def test_plan_keeps_the_best_of_each_task_only(spark):
    plan = search.exact_search(table(spark, TIES), asked(spark, [[0, 1, 0, 0]]), 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_scan_reads_needed_columns(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    plan = tables.slice_first(base, 20).select("vec_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(vec_id), LessThan(vec_id,20)]" in plan and "label" not in plan


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-1e4, 1e4, width=32), min_size=1, max_size=12))
def test_half_precision_equals_numpy(v):
    assert (kernels.to_half(np.array(v)) == np.array(v, np.float32).astype(np.float16)).all()


def test_half_precision_edges(spark):
    edges = [65504, 65520, 2.0**-14, 2.0**-24, 2.0**-25, -0.0, 1 + 2.0**-11, 1 + 3 * 2.0**-11]
    got = tables.from_float16(tables.to_float16(table(spark, [edges]))).first()["embedding"]
    with np.errstate(over="ignore"):
        want = np.array(edges, np.float32).astype(np.float16).astype(np.float32)
    assert np.array_equal(np.array(got, np.float32), want) and math.copysign(1, got[5]) == -1


def test_int8_codes(spark):
    x = [[127, 0.5, 1.5, 2.5, -0.5, -127], [0, 0, 0, 0, 0, 0], [1e-3, -2e-3, 0, 5e-4, 1e-3, 2e-3]]
    got = {r["vec_id"]: r for r in tables.quantize_int8(table(spark, x)).collect()}
    assert list(got[0]["codes"]) == [127, 0, 2, 2, 0, -127] and got[0]["scale"] == 1
    assert list(got[1]["codes"]) == [0] * 6 and got[1]["scale"] == 1
    rng = np.random.default_rng(2)
    v = rng.normal(size=(20, 16)).astype(np.float32)
    q = tables.quantize_int8(table(spark, v))
    back = {r["vec_id"]: r["embedding"] for r in tables.dequantize_int8(q).collect()}
    scale = {r["vec_id"]: r["scale"] for r in q.collect()}
    for i in back:
        assert np.abs(np.array(back[i]) - v[i]).max() <= scale[i] / 2 * (1 + 1e-6)


@pytest.mark.parametrize("metric", ["dot", "l2"])
def test_int8_kernels_agree(spark, metric):
    rng = np.random.default_rng(3)
    base = tables.quantize_int8(table(spark, rng.normal(size=(50, 12)).astype(np.float32)))
    q = asked(spark, rng.normal(size=(4, 12)).astype(np.float32))
    assert rows(search.exact_search(base, q, 5, metric, "int8")) == rows(search.exact_search(base, q, 5, metric, "int8", kernel="numpy"))


def test_refine_drops_unknown_and_repeated(spark):
    base, q = table(spark, TIES), asked(spark, [[0, 1, 0, 0], [1, 0, 0, 0]])
    cand = spark.createDataFrame([(0, 1), (0, 1), (0, 3), (0, -1), (0, 99), (1, 4)], "query_id long, vec_id long")
    got = rows(search.refine(cand, base, q, 3))
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [(0, 1, 1, 0.0), (0, 2, 3, 0.0), (1, 1, 4, 0.5)]
    assert search.candidate_depth(10) == 10 and search.candidate_depth(10, 5) == 10 and search.candidate_depth(10, 50) == 50


def test_sample_is_stable(spark):
    base = table(spark, TIES)
    a = [r["vec_id"] for r in tables.sample_random(base, 3).collect()]
    assert a == [r["vec_id"] for r in tables.sample_random(base.repartition(3), 3).collect()] and len(set(a)) == 3
    assert tables.sample_random(base, 100).count() == 6


def test_sql_functions(spark):
    vector.register_sql(spark)
    got = spark.sql("SELECT vec_dot(array(1D, 2D), array(3D, 4D)), vec_l2_squared(array(1D, 2D), array(3D, 4D)), vec_norm(array(3D, 4D)), vec_normalize(array(0D, 0D)), vec_has_nonfinite(array(1D, double('NaN')))").first()
    assert tuple(got) == (11.0, 8.0, 5.0, [0.0, 0.0], True)
    one = spark.range(1).select(vector.normalize(F.array(F.lit(3.0), F.lit(4.0))), vector.dot(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))).first()
    assert one[0] == [0.6, 0.8] and one[1] is None
