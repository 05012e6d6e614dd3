"""Searches take every row whose id is divisible by 20."""

import pytest

from vektorium.plans import registry


@pytest.mark.parametrize("name", ["exact_topk_dot", "f16_topk_dot", "ivf_search", "ivfpq_search", "opq_search", "hnsw_search"])
def test_query_rows_grow_with_the_table(spark, sf_dir, name):
    ids = {r["vec_id"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id").collect()}
    got = {r["query_id"] for r in registry.queries()[name](spark, sf_dir).select("query_id").distinct().collect()}
    assert got == {i for i in ids if i % 20 == 0}
