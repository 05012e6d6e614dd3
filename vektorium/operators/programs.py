"""Evaluation and benchmark runs: a search is timed by batches of queries, and its figures come as one row.

Times are wall-clock times of whole jobs, measured by the driver; a query's time is its share of its
batch's. Only times and figures reach the driver; results are written to a folder that all batches share, which is read
as one table: a union of kept batches would send the figures of every batch's plan with each of its tasks.

Each batch reads the base again, so batches that grew in number with the queries would make a run grow with the
square of the tables. All queries are always timed, but beyond MOST_BATCHES batches it is the batches that grow.
"""

from __future__ import annotations

import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import evaluate as stats
from .search import candidate_depth, dimension, exact_search, refine

MOST_BATCHES = 16


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint place (a local one where none is set and the master is local)."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir") or None
    if place is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        place = os.path.join(tempfile.gettempdir(), "checkpoints", "vektorium")
    return f"{place}/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _batches(queries: DataFrame, batch: int) -> list[tuple[DataFrame, int]]:
    """(queries, their number) of each batch, dealt by a hash of the id: about `batch` of them, more where that made over MOST_BATCHES."""
    n = min(MOST_BATCHES, max(1, -(-queries.count() // batch)))
    which = F.pmod(F.xxhash64("query_id"), F.lit(n))
    sizes = {r["b"]: r["n"] for r in queries.groupBy(which.alias("b")).agg(F.countDistinct("query_id").alias("n")).collect()}
    return [(queries.where(which == k), sizes.get(k, 0)) for k in range(n)]


def _timed(df: DataFrame, path: str | None = None) -> float:
    """The milliseconds that df takes; its rows are added to the table at path."""
    began = time.perf_counter()
    if path is None:
        df.write.format("noop").mode("overwrite").save()
    else:
        df.write.mode("append").parquet(path)
    return (time.perf_counter() - began) * 1e3


def _samples(spark, times: list[tuple[int, float]]) -> DataFrame:
    """One row for each query: its share of its batch's time."""
    rows = spark.createDataFrame([(int(n), float(ms)) for n, ms in times if n], "n long, batch_ms double")
    return rows.select(F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i"), (F.col("batch_ms") / F.col("n")).alias("ms")).drop("i")


def evaluate(index, base: DataFrame, queries: DataFrame, k: int, nprobe: int = 16, refine_k: int = 0, truth: DataFrame | None = None, mode: str = "full", pipeline: str = "staged", batch: int = 256, warmup: int = 1) -> DataFrame:
    """One row (mode, pipeline, queries, k, nprobe, refine_k, recall, ann_ms, refine_ms, avg_ms, p50_ms, p95_ms, p99_ms, qps, batches)
    of an index whose search takes (queries, k, nprobe).

    mode: ``full`` ranks refine_k candidates again by exact distance (none if 0), ``ann_only`` never does.
    pipeline: ``staged`` searches all batches and then refines all queries at once, whose time is shared by the
    queries; ``interleaved`` refines each batch after its search. truth: (query_id, rank, vec_id), by exact search
    if not given. batch: about so many queries in a batch, or more (see MOST_BATCHES); batches says how many there were.
    warmup: batches searched beforehand and not counted.
    """
    if mode not in ("full", "ann_only") or pipeline not in ("staged", "interleaved"):
        raise ValueError("mode is 'full' or 'ann_only', pipeline 'staged' or 'interleaved'")
    spark, depth = base.sparkSession, candidate_depth(k, refine_k if mode == "full" else 0)
    again = mode == "full" and refine_k > 0
    parts = _batches(queries, batch)
    for part, _ in parts[:warmup]:
        _timed(index.search(part, depth, nprobe))
    place = scratch(spark, "evaluate")
    try:
        times, ann_ms, refine_ms, found, final = [], 0.0, 0.0, f"{place}/found", f"{place}/again"
        for b, (part, n) in enumerate(parts):
            own = f"{place}/batch-{b}" if again and pipeline == "interleaved" else found
            ms = _timed(index.search(part, depth, nprobe), own)
            ann_ms += ms
            if own != found:
                more = _timed(refine(spark.read.parquet(own), base, part, k), final)
                refine_ms, ms = refine_ms + more, ms + more
            times.append((n, ms))
        samples = _samples(spark, times)
        if again and pipeline == "staged":
            refine_ms = _timed(refine(spark.read.parquet(found), base, queries, k), final)
            samples = stats.staged_total(samples, refine_ms).select(F.col("total_ms").alias("ms"))
        truth = stats.build_ground_truth(base, queries, k, "l2") if truth is None else truth
        asked, recall = stats.mean_recall(spark.read.parquet(final if again else found), truth, k).first()
    finally:
        _remove(spark, place)
    named = [F.lit(mode).alias("mode"), F.lit(pipeline).alias("pipeline"), F.lit(asked).cast("long").alias("queries"), F.lit(k).alias("k"), F.lit(nprobe).alias("nprobe"), F.lit(refine_k if again else 0).alias("refine_k")]
    figures = [F.lit(recall).cast("double").alias("recall"), F.lit(ann_ms).alias("ann_ms"), F.lit(refine_ms).alias("refine_ms")]
    return stats.latency_stats(samples).select(*named, *figures, "avg_ms", "p50_ms", "p95_ms", "p99_ms", "qps", F.lit(len(parts)).alias("batches"))


def bench_exact(base: DataFrame, queries: DataFrame, k: int, metric: str = "dot", dtype: str = "float32", kernel: str = "numpy", batch: int = 256, warmup: int = 1) -> DataFrame:
    """One row of bench_stats, and batches, for exact search by batches of queries as in evaluate(); warmup batches are not counted."""
    parts = _batches(queries, batch)
    for part, _ in parts[:warmup]:
        _timed(exact_search(base, part, k, metric, dtype, kernel))
    times = [(n, _timed(exact_search(base, part, k, metric, dtype, kernel))) for part, n in parts]
    width = {"float32": 4, "float16": 2, "int8": 1}[dtype]
    row = base.count() * (dimension(base, {"float32": "embedding", "int8": "codes"}.get(dtype, "embedding")) * width + (4 if dtype == "int8" else 0))
    return stats.bench_stats(_samples(base.sparkSession, times), row).withColumn("batches", F.lit(len(parts)))
