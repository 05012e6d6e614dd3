"""Exact top-k search and re-ranking of candidates.

Two kernels give the same rows: ``hof`` scores inside the JVM, ``numpy`` multiplies blocks of
vectors (Arrow batches) and sends on the best k of each block for each query. In both, what is
shuffled is the best k of each task for each query, never all scores. ``hof`` takes about 20 us a
pair, so beyond ``HOF_PAIRS`` pairs of a query and a base row the blocks are multiplied instead.

Queries are broadcast only if they are under ``BROADCAST_BYTES``; more queries are cut into
blocks and base rows into tiles, and each task compares tiles with blocks, so neither side has
to fit anywhere. Results are ordered by (score, id), so ties are settled by the smaller id.
Scores that are NaN are never ranked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels, vector

BROADCAST_BYTES = 64 << 20
HOF_PAIRS = 1_000_000
BLOCK = 512
TILE = 4_096


def best(scored: DataFrame, k: int, metric: str, value: str = "score") -> DataFrame:
    """(query_id, rank, vec_id, value): the best k rows of each query."""
    order = F.col(value).desc() if metric == "dot" else F.col(value).asc()
    w = W.partitionBy("query_id").orderBy(order, F.col("vec_id").asc())
    ranked = scored.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", value)


def dimension(df: DataFrame, vec: str) -> int | None:
    row = df.select(F.size(vec).alias("d")).where(F.col("d") >= 0).first()
    return None if row is None else row["d"]


def _check(base: DataFrame, queries: DataFrame, base_vec: str) -> int | None:
    d, q = dimension(base, base_vec), dimension(queries, "q")
    if d is None:
        raise ValueError("the base has no vectors")
    if q is not None and q != d:
        raise ValueError(f"queries have {q} dimensions, the base has {d}")
    return d


def exact_search(base: DataFrame, queries: DataFrame, k: int, metric: str = "dot", dtype: str = "float32", kernel: str = "hof", broadcast_bytes: int = BROADCAST_BYTES, digits: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score or dist): the k nearest rows of base for each of queries(query_id, q).

    base has (vec_id, embedding), or (vec_id, codes, scale) with dtype int8, or (vec_id, bits) with
    dtype float16. k = 0 gives no rows, k over the size of base gives all of it; an empty base or
dtype float16. k = 0 gives no rows, k over the size of base gives all of it; an empty base or
    another number of dimensions raises. digits: scores are rounded so before they are ranked.
    """
    if k < 0:
        raise ValueError("k >= 0")
    value = "score" if metric == "dot" else "dist"
    if dtype == "float16":
        from .tables import from_float16

        base, dtype = from_float16(base), "float32"
    name = "codes" if dtype == "int8" else "embedding"
    d = _check(base, queries, name)
    n = queries.count()
    small = n * d * 8 <= broadcast_bytes
    rounded = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    room = kernels.NEAR if digits is None else 2 * 10.0**-digits
    if kernel == "hof" and small and k <= 1000 and n * base.count() <= HOF_PAIRS:
        scale = F.col("scale") if dtype == "int8" else None
        pairs = base.crossJoin(F.broadcast(queries.select("query_id", "q")))
        return best(pairs.select("query_id", "vec_id", rounded(vector.score(metric, dtype, "q", name, scale)).alias(value)), k, metric, value)
    if kernel not in ("hof", "numpy"):
        raise ValueError("kernel is 'hof' or 'numpy'")
    plain = base.select("vec_id", F.col(name).cast("array<float>").alias("x"), (F.col("scale") if dtype == "int8" else F.lit(1.0)).cast("double").alias("scale"))
    scored = (_broadcast_blocks if small else _tiles_and_blocks)(plain, queries, k, metric, d, dtype, room)
    return best(scored.select("query_id", "vec_id", rounded(F.col("value")).alias(value)), k, metric, value)


def _scored(x: np.ndarray, scale: np.ndarray, q: np.ndarray, k: int, metric: str, dtype: str, room: float):
    if dtype != "int8":
        return kernels.block_topk(metric, x, q, k, room)
    if metric == "l2":  # decoded in single precision
        return kernels.block_topk(metric, (x.astype(np.float32) * scale[:, None].astype(np.float32)).astype(np.float64), q, k, room)
    i, j, _ = kernels.block_topk(metric, x * scale[:, None], q, k, room)
    return i, j, kernels.exact(metric, x[j], q[i]) * scale[j]


_OUT = "query_id long, vec_id long, value double"


def _batch(ids, vec_ids, out) -> pa.RecordBatch:
    i, j, v = out
    return pa.RecordBatch.from_arrays([pa.array(ids[i], pa.int64()), pa.array(vec_ids[j], pa.int64()), pa.array(v, pa.float64())], ["query_id", "vec_id", "value"])


def _broadcast_blocks(base: DataFrame, queries: DataFrame, k: int, metric: str, d: int, dtype: str, room: float) -> DataFrame:
    t = queries.select(F.col("query_id").cast("long"), F.col("q").cast("array<double>")).toArrow()
    sent = base.sparkSession.sparkContext.broadcast((t["query_id"].to_numpy(), kernels.matrix(t["q"], d)))

    def run(batches):
        ids, q = sent.value
        for b in batches:
            x, scale, vec_ids = kernels.matrix(b.column(1), d), b.column(2).to_numpy(), b.column(0).to_numpy()
            for at in range(0, len(ids), BLOCK):
                yield _batch(ids[at : at + BLOCK], vec_ids, _scored(x, scale, q[at : at + BLOCK], k, metric, dtype, room))

    return base.select(F.col("vec_id").cast("long"), "x", "scale").mapInArrow(run, _OUT)


def _tiles_and_blocks(base: DataFrame, queries: DataFrame, k: int, metric: str, d: int, dtype: str, room: float) -> DataFrame:
    """Tiles of base against blocks of queries, each a row of packed arrays."""

    def pack(size, names):
        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, size):
                    p = b.slice(at, size)
                    x = kernels.matrix(p.column(1), d)
                    yield pa.RecordBatch.from_arrays([pa.array([p.column(0).to_numpy().astype("<i8").tobytes()]), pa.array([x.tobytes()]), pa.array([p.column(2).to_numpy().astype("<f8").tobytes()])], names)

        return run

    tiles = base.select(F.col("vec_id").cast("long"), "x", "scale").mapInArrow(pack(TILE, ["ids", "x", "scale"]), "ids binary, x binary, scale binary")
    blocks = queries.select(F.col("query_id").cast("long"), F.col("q").cast("array<double>"), F.lit(1.0).alias("one")).mapInArrow(pack(BLOCK, ["q_ids", "q", "one"]), "q_ids binary, q binary, one binary").drop("one")

    def run(batches):
        for b in batches:
            for ids, x, scale, q_ids, q in zip(*(c.to_pylist() for c in b.columns)):
                out = _scored(np.frombuffer(x).reshape(-1, d), np.frombuffer(scale), np.frombuffer(q).reshape(-1, d), k, metric, dtype, room)
                yield _batch(np.frombuffer(q_ids, "<i8"), np.frombuffer(ids, "<i8"), out)

    return tiles.crossJoin(blocks).mapInArrow(run, _OUT)


def search_first_query(base: DataFrame, queries: DataFrame, k: int, metric: str = "dot") -> DataFrame:
    """exact_search for the query with the smallest id only."""
    return exact_search(base, queries.orderBy("query_id").limit(1), k, metric)


def refine(candidates: DataFrame, base: DataFrame, queries: DataFrame, k: int, dtype: str = "float32") -> DataFrame:
    """(query_id, rank, vec_id, dist): candidates(query_id, vec_id) ranked again by exact squared distance.

    Repeated candidates count once; ids below 0 or unknown to base give no row, so a query may have
    under k rows. Candidates meet base by an equi-join on vec_id; queries join by query_id.
    """
    wanted = candidates.where("vec_id >= 0").select("query_id", "vec_id").distinct()
    name, scale = ("codes", F.col("scale")) if dtype == "int8" else ("embedding", None)
    pairs = wanted.join(base, "vec_id").join(queries.select("query_id", "q"), "query_id")
    return best(pairs.select("query_id", "vec_id", vector.score("l2", dtype, "q", name, scale).alias("dist")), k, "l2", "dist")


def candidate_depth(k: int, refine_k: int = 0) -> int:
    """How many candidates an approximate search is asked for."""
    return max(refine_k, k) if refine_k > 0 else k
