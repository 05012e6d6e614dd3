"""Texts go to Python in batches bounded by bytes, however many rows a task has; results don't depend on them."""

import pyarrow as pa
import pytest

from vektorium.functions.batches import BATCH_KEY
from vektorium.plans import registry


@pytest.fixture(autouse=True)
def unset(spark):
    spark.conf.unset(BATCH_KEY)
    yield
    spark.conf.unset(BATCH_KEY)


def largest(spark):
    """MB of the largest batch of 2,000 texts of 10 kB."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})

    texts = spark.range(0, 2000, 1, 1).selectExpr("repeat('word ', 2000) AS text")
    return max(r["n"] for r in texts.mapInArrow(run, "n long").collect()) / 1e6


@pytest.mark.parametrize("name", ["chunk_numbering", "chunk_documents", "split_sections", "hash_embed_topk"])
def test_text_batches_are_bounded(spark, sf_dir, name):
    registry.queries()[name](spark, sf_dir)
    assert largest(spark) < 4


def test_numbering_does_not_depend_on_batches(spark, sf_dir):
    want = sorted(map(tuple, registry.queries()["chunk_numbering"](spark, sf_dir).collect()))
    spark.conf.set(BATCH_KEY, "5000")
    assert sorted(map(tuple, registry.queries()["chunk_numbering"](spark, sf_dir).collect())) == want
    assert spark.conf.get(BATCH_KEY) == "5000"
