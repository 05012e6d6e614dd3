"""hash_embed_topk takes every text of benchmark, however many there are, with and without a broadcast."""

import pytest

from vektorium.operators import search
from vektorium.plans import registry


@pytest.mark.parametrize("broadcast", [None, 0])
def test_no_text_is_left_out(spark, tmp_path, monkeypatch, broadcast):
    n = 10_050
    spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(n).selectExpr("id AS item_id", "concat('gamma w', id % 7) AS text").write.parquet(f"{tmp_path}/benchmark.parquet")
    if broadcast is not None:
        monkeypatch.setattr(search, "BROADCAST_BYTES", broadcast)
    got = registry.queries()["hash_embed_topk"](spark, str(tmp_path)).where("rank = 1").collect()
    assert sorted(r["query_id"] for r in got) == list(range(n)) and {r["vec_id"] for r in got} == {2}
