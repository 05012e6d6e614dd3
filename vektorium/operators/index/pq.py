"""Product quantization in inverted lists (IVF-PQ), with an optional learned rotation (OPQ).

Residuals to the list's centroid are cut into ``m`` parts, each coded by the nearest of
2**bits codewords. A search adds up, for every coded row, the distances of the query's residual
parts to the codewords (looked up in a table for each query and list).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions import kernels
from ..search import BLOCK, TILE, best, candidate_depth, refine
from .kmeans import local_kmeans
from .store import SPREAD, by_list, load_model, meeting, nearest_lists, packed, probed, pruned, save_model

TRAIN = 200_000


def train_codebooks(x: np.ndarray, m: int, bits: int, steps: int = 10, seed: int = 42) -> np.ndarray:
    """(m, 2**bits, dim / m) codewords of a sample's rows."""
    if x.shape[1] % m:
        raise ValueError(f"{m} parts do not divide {x.shape[1]} dimensions")
    return np.stack([local_kmeans(part, 1 << bits, steps, seed + i) for i, part in enumerate(np.split(x, m, axis=1))])


def encode(x: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    """(rows, m) codes; ties go to the smaller code."""
    return np.stack([nearest_lists(part, words, 1)[0][:, 0] for part, words in zip(np.split(x, len(codebooks), axis=1), codebooks)], axis=1).astype(np.int16)


def decode(codes: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    return np.concatenate([words[codes[:, i]] for i, words in enumerate(codebooks)], axis=1)


def distances(q: np.ndarray, codes: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    """Squared distances of one query to coded rows, by a table of its distances to all codewords."""
    parts = q.reshape(len(codebooks), 1, -1)
    table = ((codebooks - parts) ** 2).sum(axis=2)
    return table[np.arange(len(codebooks))[None, :], codes].sum(axis=1)


def nearest_coded(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, codes: np.ndarray, codebooks: np.ndarray, k: int, digits: int | None = None):
    """Batches of (query_id, vec_id, dist): the k coded rows nearest to each query by distances(), rounded if digits is given; ties go to the smaller id.

    A product with the decoded rows leaves out what is farther than the k nearest by more than its own error and the rounding.
    """
    m, back = len(codebooks), decode(codes, codebooks)
    most = max(1.0, 2 * ((back * back).sum(axis=1).max(initial=0) + (q * q).sum(axis=1).max(initial=0)))
    near = kernels.NEAR * most + (0 if digits is None else 4 * 10.0**-digits)
    step = max(1, min((1 << 21) // codebooks.size, (1 << 22) // (m * max(1, min(k, len(ids))))))
    for at in range(0, len(q), step):
        part = q[at : at + step]
        i, j = kernels.shortlist("l2", back, part, k, near)
        table = ((codebooks - part.reshape(len(part), m, 1, -1)) ** 2).sum(axis=3)
        dist = table[i[:, None], np.arange(m)[None, :], codes[j]].sum(axis=1)
        dist = dist if digits is None else np.round(dist, digits)
        order = np.lexsort((ids[j], dist, i))
        order = order[np.arange(len(order)) - np.searchsorted(i, i) < k]  # i is in order, sorted or not
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[at:][i[order]]), pa.array(ids[j[order]]), pa.array(dist[order])], ["query_id", "vec_id", "dist"])


def learn_rotation(x: np.ndarray, m: int, bits: int, rounds: int = 25, seed: int = 42) -> np.ndarray:
    """(dim, dim) rotation: codes with the rotation fixed, then the rotation that best maps rows to their
    decoded ones (orthogonal Procrustes), by turns; the best one seen is returned."""
    r, seen = np.eye(x.shape[1]), []
    for step in range(rounds + 1):
        y = x @ r.T
        books = train_codebooks(y, m, bits, 4, seed)
        back = decode(encode(y, books), books)
        seen.append((((y - back) ** 2).sum(), step, r))
        u, _, v = np.linalg.svd(back.T @ x)
        r = u @ v
    return min(seen, key=lambda s: s[:2])[2]


def pq_encode(base: DataFrame, codebooks: np.ndarray, vec: str = "embedding") -> DataFrame:
    """(vec_id, codes array<smallint>) of whole vectors under given codebooks."""
    sent = base.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches):
        for b in batches:
            codes = encode(kernels.matrix(b.column(1), sent.value.shape[0] * sent.value.shape[2]), sent.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(codes), pa.list_(pa.int16()))], ["vec_id", "codes"])

    return base.select(F.col("vec_id").cast("long"), vec).mapInArrow(run, "vec_id long, codes array<smallint>")


def adc_search(coded: DataFrame, codebooks: np.ndarray, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, dist): the best k of coded(vec_id, codes) for each query, by looked-up distances
    rounded to 9 digits (so equal codes tie). Blocks of queries meet every batch of codes."""
    m, sent = len(codebooks), coded.sparkSession.sparkContext.broadcast(codebooks)
    one = F.lit(0).alias("list_id")
    rows = coded.select(one, F.col("vec_id").cast("long"), F.col("codes").cast("array<double>"))
    tiles = packed(rows, TILE, [("vec_id", "<i8", 0), ("codes", "<i2", m)]).drop("list_id")
    blocks = packed(queries.select(one, F.col("query_id").cast("long"), F.col("q").cast("array<double>")), BLOCK, [("query_id", "<i8", 0), ("q", "<f8", m * codebooks.shape[2])]).drop("list_id")

    def run(batches):
        for b in batches:
            for ids, codes, q_ids, q in zip(*(c.to_pylist() for c in b.columns)):
                ids, codes, q_ids = np.frombuffer(ids, "<i8"), np.frombuffer(codes, "<i2").reshape(-1, m), np.frombuffer(q_ids, "<i8")
                yield from nearest_coded(q_ids, np.frombuffer(q).reshape(len(q_ids), -1), ids, codes, sent.value, k, 9)

    return best(tiles.crossJoin(blocks).mapInArrow(run, "query_id long, vec_id long, dist double"), k, "l2", "dist")


class IvfPqIndex:
    """Model arrays (centroids, codebooks, rotation) and lists(list_id, vec_id, codes)."""

    def __init__(self, model: dict[str, np.ndarray], lists: DataFrame):
        self.model, self.lists = model, lists

    @classmethod
    def build(cls, base: DataFrame, nlist: int = 4096, m: int = 48, bits: int = 8, train: int = TRAIN, rotate: bool = False, rounds: int = 25, steps: int = 10, seed: int = 42) -> IvfPqIndex:
        """Trained on the `train` rows of the smallest ids (the only rows that reach the driver); every row is coded, and the codes kept."""
        rows = base.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).orderBy("vec_id").limit(train).toArrow()
        x = kernels.matrix(rows["x"])
        r = learn_rotation(x, m, bits, rounds, seed) if rotate else np.eye(x.shape[1])
        y = x @ r.T
        centroids = local_kmeans(y, nlist, steps, seed)
        residual = y - centroids[nearest_lists(y, centroids, 1)[0][:, 0]]
        model = {"centroids": centroids, "codebooks": train_codebooks(residual, m, bits, steps, seed), "rotation": r}
        return cls(model, by_list(cls.coded(base, model)).persist())

    @staticmethod
    def coded(base: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
        sent = base.sparkSession.sparkContext.broadcast(model)

        def run(batches):
            c, books, r = (sent.value[k] for k in ("centroids", "codebooks", "rotation"))
            for b in batches:
                y = kernels.matrix(b.column(1), r.shape[1]) @ r.T
                lists = nearest_lists(y, c, 1)[0][:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), b.column(0), pa.array(list(encode(y - c[lists], books)), pa.list_(pa.int16()))], ["list_id", "vec_id", "codes"])

        return base.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, T._parse_datatype_string("list_id int, vec_id long, codes array<smallint>"))

    def add(self, rows: DataFrame) -> IvfPqIndex:
        return IvfPqIndex(self.model, self.lists.unionByName(self.coded(rows, self.model)))

    def save(self, path: str) -> None:
        save_model(self.lists.sparkSession, self.model, f"{path}/model")
        by_list(self.lists).write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/lists")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IvfPqIndex:
        return cls(load_model(spark, f"{path}/model"), spark.read.parquet(f"{path}/lists"))

    def candidates(self, queries: DataFrame, k: int, nprobe: int = 16, spread: int = SPREAD) -> DataFrame:
        """(query_id, rank, vec_id, dist): the best k by coded distance in the probed lists."""
        d, m = self.model["centroids"].shape[1], len(self.model["codebooks"])
        sent = self.lists.sparkSession.sparkContext.broadcast(self.model)
        probes = probed(queries, self.model["centroids"], nprobe, self.model["rotation"])
        lists = pruned(self.lists, probes, nprobe < len(self.model["centroids"]))
        blocks = packed(probes.repartition("list_id"), BLOCK, [("query_id", "<i8", 0), ("q", "<f8", d)])
        rows = lists.select(F.col("list_id").cast("int"), "vec_id", F.col("codes").cast("array<double>"))
        tiles = packed(rows, TILE, [("vec_id", "<i8", 0), ("codes", "<i2", m)])

        def run(batches):
            c, books = sent.value["centroids"], sent.value["codebooks"]
            for b in batches:
                for at, ids, codes, q_ids, q in zip(*(b.column(n).to_pylist() for n in ("list_id", "vec_id", "codes", "query_id", "q"))):
                    ids, codes = np.frombuffer(ids, "<i8"), np.frombuffer(codes, "<i2").reshape(-1, m)
                    yield from nearest_coded(np.frombuffer(q_ids, "<i8"), np.frombuffer(q).reshape(-1, d) - c[at], ids, codes, books, k)

        return best(meeting(tiles, blocks, spread).mapInArrow(run, "query_id long, vec_id long, dist double"), k, "l2", "dist")

    def search(self, queries: DataFrame, k: int, nprobe: int = 16, refine_k: int = 0, base: DataFrame | None = None) -> DataFrame:
        """candidates(), ranked again by exact distance to base where refine_k > 0."""
        got = self.candidates(queries, candidate_depth(k, refine_k), nprobe)
        if refine_k <= 0:
            return got
        if base is None:
            raise ValueError("refine_k needs the base table")
        return refine(got, base, queries, k)
