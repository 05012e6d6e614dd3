"""Hierarchical navigable small-world graphs, one for each shard of the base table.

A shard is one packed row of at most ``shard_rows`` vectors (rows are dealt by a hash of the id),
so graphs are built and searched in parallel. A search looks into every shard and merges, which
does more work than one graph and finds at least about as much.

How wide a beam finds the nearest rows depends on the number of rows and on the data. So each graph is
tried with some of its own rows once it is built, and keeps the beam that it needs; a search takes that
one where it is asked for a narrower one.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions import kernels
from ..search import BLOCK, best, dimension

SHARD_ROWS = 20_000
#: Rows a graph is tried with, how many nearest rows of each, and the share of them that its beam has to find.
PROBES, NEAREST, FOUND = 256, 10, 0.94


class Graph:
    """Vectors x and, for each node and level, its neighbours."""

    def __init__(self, x: np.ndarray, m: int = 16, links: list | None = None, entry: int = -1):
        self.x, self.m, self.links, self.entry = x, m, links if links is not None else [], entry

    def _dist(self, q, nodes):
        diff = self.x[nodes] - q
        return np.einsum("ij,ij->i", diff, diff)

    def _look(self, q, start: list[tuple[float, int]], ef: int, level: int) -> list[tuple[float, int]]:
        """The ef nearest nodes found from start by best-first search, nearest first."""
        seen = {n for _, n in start}
        todo = list(start)
        heapq.heapify(todo)
        found = [(-d, -n) for d, n in start]
        heapq.heapify(found)
        while len(found) > ef:
            heapq.heappop(found)
        while todo:
            d, node = heapq.heappop(todo)
            if len(found) >= ef and d > -found[0][0]:
                break
            new = [n for n in self.links[node][level] if n not in seen]
            if not new:
                continue
            seen.update(new)
            for dn, n in zip(self._dist(q, new).tolist(), new):
                if len(found) < ef or dn < -found[0][0]:
                    heapq.heappush(todo, (dn, n))
                    heapq.heappush(found, (-dn, -n))
                    if len(found) > ef:
                        heapq.heappop(found)
        return sorted((-d, -n) for d, n in found)

    def _spread(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours that are nearer to the node than to one another, filled up with the nearest of the rest."""
        kept: list[int] = []
        for d, n in near:
            if len(kept) >= most:
                break
            if not kept or (self._dist(self.x[n], kept) > d).all():
                kept.append(n)
        have = set(kept)
        return kept + [n for _, n in near if n not in have][: most - len(kept)]

    def insert(self, node: int, level: int, ef: int) -> None:
        self.links.append([[] for _ in range(level + 1)])
        if self.entry < 0:
            self.entry = node
            return
        q, top = self.x[node], len(self.links[self.entry]) - 1
        at = [(float(self._dist(q, [self.entry])[0]), self.entry)]
        for k in range(top, level, -1):
            at = self._look(q, at, 1, k)
        for k in range(min(top, level), -1, -1):
            at = self._look(q, at, ef, k)
            most = 2 * self.m if k == 0 else self.m
            mine = self._spread(at, self.m)
            self.links[node][k] = mine
            for n in mine:
                back = self.links[n][k]
                back.append(node)
                if len(back) > most:
                    self.links[n][k] = self._spread(sorted(zip(self._dist(self.x[n], back).tolist(), back)), most)
        if level > top:
            self.entry = node

    def search(self, q: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        at = [(float(self._dist(q, [self.entry])[0]), self.entry)]
        for level in range(len(self.links[self.entry]) - 1, 0, -1):
            at = self._look(q, at, 1, level)
        return self._look(q, at, max(ef, k), 0)[:k]

    def beam(self, pick: np.ndarray, nearest: int, ef: int) -> int:
        """The narrowest of ef, 1.5 ef, ... that finds FOUND of the nearest rows of the rows of pick."""
        i, j, v = kernels.block_topk("l2", self.x, self.x[pick], nearest)
        order = np.lexsort((j, v, i))
        near = [set(part[:nearest].tolist()) for part in np.split(j[order], np.searchsorted(i[order], np.arange(1, len(pick))))]
        while ef < len(self.x) and sum(len(near[k].intersection(n for _, n in self.search(self.x[p], nearest, ef))) for k, p in enumerate(pick)) < FOUND * sum(map(len, near)):
            ef += ef // 2
        return ef

    def flat(self) -> np.ndarray:
        out = [self.entry, len(self.links)]
        for levels in self.links:
            out.append(len(levels))
            for near in levels:
                out += [len(near), *near]
        return np.array(out, "<i4")

    @classmethod
    def from_flat(cls, x: np.ndarray, m: int, flat: np.ndarray) -> Graph:
        f, at, links = flat.tolist(), 2, []
        for _ in range(f[1]):
            n, at, levels = f[at], at + 1, []
            for _ in range(n):
                c = f[at]
                levels.append(f[at + 1 : at + 1 + c])
                at += 1 + c
            links.append(levels)
        return cls(x, m, links, f[0])


_SHARD = "shard int, m int, ef int, dim int, ids binary, x binary, links binary"


class HnswIndex:
    """shards: one row for each graph, kept once built."""

    def __init__(self, shards: DataFrame):
        self.shards = shards

    @classmethod
    def build(cls, base: DataFrame, m: int = 16, ef_construction: int = 200, shard_rows: int = SHARD_ROWS, seed: int = 42) -> HnswIndex:
        n, d = base.count(), dimension(base, "embedding")
        if not n:
            raise ValueError("the base has no vectors")
        shards = math.ceil(n / shard_rows)
        nearest = min(NEAREST, math.ceil(NEAREST / shards) + 2)  # the others are in other shards
        rows = base.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>").alias("x"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"))

        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by("vec_id")
            shard, ids, x = t["shard"][0].as_py(), t["vec_id"].to_numpy(), kernels.matrix(t["x"], d)
            g, rng = Graph(x, m), np.random.default_rng([seed, shard])
            for node, u in enumerate(rng.random(len(x)).tolist()):
                g.insert(node, int(-math.log(1 - u) / math.log(m)), ef_construction)
            ef = g.beam(np.sort(rng.choice(len(x), min(len(x), PROBES), replace=False)), nearest, max(ef_construction, NEAREST))
            return pa.table({"shard": pa.array([shard], pa.int32()), "m": pa.array([m], pa.int32()), "ef": pa.array([ef], pa.int32()), "dim": pa.array([d], pa.int32()), "ids": pa.array([ids.astype("<i8").tobytes()]), "x": pa.array([x.astype("<f4").tobytes()]), "links": pa.array([g.flat().tobytes()])})

        return cls(rows.groupBy("shard").applyInArrow(run, _SHARD).persist())

    def save(self, path: str) -> None:
        self.shards.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> HnswIndex:
        shards = spark.read.parquet(path)
        return cls(shards if "ef" in shards.columns else shards.withColumn("ef", F.lit(0)))  # written before beams were kept

    def search(self, queries: DataFrame, k: int, ef: int = 64) -> DataFrame:
        """(query_id, rank, vec_id, dist) by squared distance; every shard meets every block of queries. ef: the least width of the beam."""

        def pack(batches):
            for b in batches:
                for at in range(0, b.num_rows, BLOCK):
                    p = b.slice(at, BLOCK)
                    yield pa.RecordBatch.from_arrays([pa.array([p.column(0).to_numpy().astype("<i8").tobytes()]), pa.array([kernels.matrix(p.column(1)).tobytes()])], ["q_ids", "q"])

        blocks = queries.select(F.col("query_id").cast("long"), F.col("q").cast("array<double>")).mapInArrow(pack, "q_ids binary, q binary")

        def run(batches):
            for b in batches:
                for m, own, d, ids, x, links, q_ids, q in zip(*(b.column(c).to_pylist() for c in ("m", "ef", "dim", "ids", "x", "links", "q_ids", "q"))):
                    ids = np.frombuffer(ids, "<i8")
                    g = Graph.from_flat(np.frombuffer(x, "<f4").reshape(-1, d).astype(np.float64), m, np.frombuffer(links, "<i4"))
                    q_ids = np.frombuffer(q_ids, "<i8")
                    q = np.frombuffer(q).reshape(len(q_ids), -1)
                    if q.shape[1] != d:
                        raise ValueError(f"queries have {q.shape[1]} dimensions, the index has {d}")
                    got = [(int(i), int(ids[n]), dist) for i, row in zip(q_ids, q) for dist, n in g.search(row, k, max(ef, own))]
                    yield pa.RecordBatch.from_pylist([dict(zip(("query_id", "vec_id", "dist"), r)) for r in got], schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("dist", pa.float64())]))

        return best(self.shards.crossJoin(blocks).mapInArrow(run, "query_id long, vec_id long, dist double"), k, "l2", "dist")
