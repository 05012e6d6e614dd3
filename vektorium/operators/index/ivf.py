"""Inverted lists over full vectors (IVF-Flat)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions import kernels
from ..search import BLOCK, TILE, best
from .kmeans import lloyd
from .store import SPREAD, assigned, by_list, load_model, meeting, packed, probed, pruned, save_model


class IvfIndex:
    """centroids (nlist, dim) and lists: a DataFrame with list_id, vec_id and embedding."""

    def __init__(self, centroids: np.ndarray, lists: DataFrame):
        self.centroids, self.lists = centroids, lists

    @classmethod
    def build(cls, base: DataFrame, nlist: int = 4096, train: int | None = 50_000, steps: int = 2) -> IvfIndex:
        """Centroids from the rows with ids below `train`; every row is listed. The lists are kept for the searches that follow."""
        centroids = lloyd(base.select("vec_id", "embedding"), nlist, steps, train)
        return cls(centroids, by_list(assigned(base, centroids)).persist())

    def add(self, rows: DataFrame) -> IvfIndex:
        """The index with more rows, assigned to the same centroids."""
        return IvfIndex(self.centroids, self.lists.unionByName(assigned(rows, self.centroids)))

    def save(self, path: str) -> None:
        """Lists are laid out in folders by list_id; a search of the loaded index reads the probed ones only."""
        save_model(self.lists.sparkSession, {"centroids": self.centroids}, f"{path}/model")
        by_list(self.lists).write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/lists")

    @staticmethod
    def append(path: str, rows: DataFrame) -> None:
        """Add rows to a saved index."""
        centroids = load_model(rows.sparkSession, f"{path}/model")["centroids"]
        by_list(assigned(rows, centroids)).write.mode("append").partitionBy("list_id").parquet(f"{path}/lists")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IvfIndex:
        return cls(load_model(spark, f"{path}/model")["centroids"], spark.read.parquet(f"{path}/lists"))

    def list_sizes(self) -> DataFrame:
        return self.lists.groupBy("list_id").agg(F.count("*").alias("n"))

    def search(self, queries: DataFrame, k: int, nprobe: int = 16, metric: str = "l2", spread: int = SPREAD) -> DataFrame:
        """(query_id, rank, vec_id, dist or score): the best k in the nprobe lists nearest to each query.

        Packed parts of lists meet packed queries by an equi-join on list_id; a long list is many parts, dealt out
        to ``spread`` tasks, to each of which the queries go. Only lists that some query probes are scanned.
        """
        d = self.centroids.shape[1]
        value = "score" if metric == "dot" else "dist"
        probes = probed(queries, self.centroids, nprobe)
        lists = pruned(self.lists, probes, nprobe < len(self.centroids))
        blocks = packed(probes.repartition("list_id"), BLOCK, [("query_id", "<i8", 0), ("q", "<f8", d)])
        tiles = packed(lists.select(F.col("list_id").cast("int"), F.col("vec_id").cast("long"), "embedding"), TILE, [("vec_id", "<i8", 0), ("embedding", "<f4", d)])

        def run(batches):
            for b in batches:
                for ids, x, q_ids, q in zip(*(b.column(c).to_pylist() for c in ("vec_id", "embedding", "query_id", "q"))):
                    i, j, v = kernels.block_topk(metric, np.frombuffer(x, "<f4").reshape(-1, d).astype(np.float64), np.frombuffer(q).reshape(-1, d), k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(q_ids, "<i8")[i]), pa.array(np.frombuffer(ids, "<i8")[j]), pa.array(v)], ["query_id", "vec_id", value])

        return best(meeting(tiles, blocks, spread).mapInArrow(run, f"query_id long, vec_id long, {value} double"), k, metric, value)
