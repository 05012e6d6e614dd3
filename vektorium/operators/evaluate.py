"""Ground truth, recall, and latency and throughput statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import exact_search


def build_ground_truth(base: DataFrame, queries: DataFrame, k: int, metric: str = "dot", kernel: str = "numpy") -> DataFrame:
    """(query_id, rank, vec_id, score or dist) by exact search; raises if base has under k rows."""
    if base.limit(k).count() < k:
        raise ValueError(f"the base has under {k} rows")
    return exact_search(base, queries, k, metric, kernel=kernel)


def hits(result: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id) of the truth that the result has."""
    got = result.where(F.col("rank") <= k).select("query_id", "vec_id")
    return truth.where(F.col("rank") <= k).select("query_id", "vec_id").join(got, ["query_id", "vec_id"], "left_semi")


def recall_at_k(result: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, hits, recall) for each query of truth; a query without results has 0."""
    want = truth.where(F.col("rank") <= k).select("query_id", "vec_id")
    got = result.where(F.col("rank") <= k).select("query_id", "vec_id", F.lit(1).alias("hit")).distinct()
    hits = F.coalesce(F.sum("hit"), F.lit(0)).cast("long")
    return want.join(got, ["query_id", "vec_id"], "left").groupBy("query_id").agg(hits.alias("hits"), (hits / k).alias("recall"))


def mean_recall(result: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(queries, recall): one row."""
    return recall_at_k(result, truth, k).agg(F.count("*").alias("queries"), F.avg("recall").alias("recall"))


def latency_stats(samples: DataFrame, ms: str = "ms") -> DataFrame:
    """(n, avg_ms, p50_ms, p95_ms, p99_ms, qps) with linear interpolation between samples."""
    p = {f"p{x}_ms": F.expr(f"percentile({ms}, {x / 100})") for x in (50, 95, 99)}
    avg = F.avg(ms)
    return samples.agg(F.count(ms).alias("n"), avg.alias("avg_ms"), *[c.alias(n) for n, c in p.items()], F.when(avg > 0, 1000 / avg).otherwise(0.0).alias("qps"))


def bench_stats(samples: DataFrame, bytes_per_query: int, ms: str = "ms") -> DataFrame:
    """latency_stats with total_ms, bytes_per_query and gb_per_s."""
    s = latency_stats(samples, ms)
    rate = F.when(F.col("avg_ms") > 0, bytes_per_query * F.lit(1e-6) / F.col("avg_ms")).otherwise(0.0)
    return s.select("*", (F.col("avg_ms") * F.col("n")).alias("total_ms"), F.lit(bytes_per_query).cast("long").alias("bytes_per_query"), rate.alias("gb_per_s"))


def staged_total(samples: DataFrame, refine_total_ms: float, ms: str = "ms") -> DataFrame:
    """Each query's time plus its share of a refinement that ran for all queries at once."""
    n = samples.agg(F.count(ms).alias("n"))
    return samples.crossJoin(F.broadcast(n)).withColumn("total_ms", F.col(ms) + F.lit(float(refine_total_ms)) / F.col("n")).drop("n")


def result_line(stats: DataFrame) -> DataFrame:
    """(line): 'RESULT key=value ...' of each row, keys in column order."""
    cells = [F.concat(F.lit(f" {c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in stats.columns]
    return stats.select(F.concat(F.lit("RESULT"), *cells).alias("line"))
