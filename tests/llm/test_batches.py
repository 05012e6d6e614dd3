"""The pipeline's Arrow batches are bounded by bytes, its results don't depend on them, and workers give memory back."""

import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm import data
from vektorium.llm import kernels, shared


@pytest.fixture(autouse=True)
def unset(spark):
    spark.conf.unset(shared.BATCH_KEY)
    yield
    spark.conf.unset(shared.BATCH_KEY)


def largest(spark):
    """MB of the largest batch of 2,000 texts of 10 kB."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})

    texts = spark.range(0, 2000, 1, 1).selectExpr("repeat('word ', 2000) AS text")
    return max(r["n"] for r in texts.mapInArrow(run, "n long").collect()) / 1e6


@pytest.mark.parametrize("name", ["language_id", "line_dedup", "simhash", "bpe"])
def test_batches_are_bounded(spark, sf_dir, name):
    docs = spark.createDataFrame([(1, "one two three", "en"), (2, "one two three", "en"), (3, "four five", "en")], "doc_id long, text string, lang string")
    dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)
    assert largest(spark) < 4


def test_own_bound_stays(spark):
    spark.conf.set(shared.BATCH_KEY, "1000000")
    shared.small_batches(spark)
    assert spark.conf.get(shared.BATCH_KEY) == "1000000"


@pytest.mark.parametrize("name", ["language_id", "line_dedup", "simhash", "bpe"])
def test_results_do_not_depend_on_batches(spark, sf_dir, name):
    docs = data.real(spark, sf_dir).limit(400).unionByName(data.docs(spark), allowMissingColumns=True).cache()
    cols = ["doc_id", "n_tokens", "ids_sha256"] if name == "bpe" else ["doc_id", "text"]
    want = data.kept(dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir), *cols)
    spark.conf.set(shared.BATCH_KEY, "3000")
    assert data.kept(dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir), *cols) == want
    docs.unpersist()


def held_mb():
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) / 1024


def test_memory_is_given_back():
    def work(n):
        many = [np.ones(12_000) for _ in range(n)]
        return np.ones(12_000) * len(many)  # behind the others, so that the heap does not shrink by itself

    before = held_mb()
    out = work(2000)  # 192 MB
    kernels.release()
    assert out[0] == 2000 and held_mb() < before + 60
