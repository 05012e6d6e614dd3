"""Lloyd's k-means with a fixed number of steps, seeded by the rows of the smallest ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import kernels
from .store import nearest_lists


def seeds(base: DataFrame, n: int, id_col: str = "vec_id", vec: str = "embedding") -> np.ndarray:
    rows = base.select(id_col, vec).orderBy(id_col).limit(n).collect()
    if len(rows) < n:
        raise ValueError(f"{n} lists, but only {len(rows)} vectors to train on")
    return np.array([r[vec] for r in rows], np.float64)


def lloyd(base: DataFrame, nlist: int, steps: int = 2, train: int | None = None, id_col: str = "vec_id", vec: str = "embedding") -> np.ndarray:
    """(nlist, dim) centroids. train: ids below it are trained on. A list without vectors keeps its centroid.

    Each step is one pass with a partial sum for each task and list; only centroids reach the driver.
    """
    rows = base if train is None else base.where(F.col(id_col) < train)
    c = seeds(rows, nlist, id_col, vec)
    for _ in range(steps):
        sent = base.sparkSession.sparkContext.broadcast(c)

        def run(batches, sent=sent):
            c = sent.value
            sums, n = np.zeros_like(c), np.zeros(len(c), np.int64)
            for b in batches:
                x = kernels.matrix(b.column(0), c.shape[1])
                lists = nearest_lists(x, c, 1)[0][:, 0]
                np.add.at(sums, lists, x)
                n += np.bincount(lists, minlength=len(c))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.float64()))], ["list_id", "n", "sums"])

        parts = rows.select(vec).mapInArrow(run, "list_id int, n long, sums array<double>")
        parts = parts.select("list_id", "n", F.posexplode("sums").alias("dim", "s"))
        t = parts.groupBy("list_id", "dim").agg((F.sum("s") / F.sum("n")).alias("mean")).toArrow()
        c = c.copy()
        c[t["list_id"].to_numpy(), t["dim"].to_numpy()] = t["mean"].to_numpy()
        sent.unpersist()
    return c


def local_kmeans(x: np.ndarray, k: int, steps: int, seed: int = 42) -> np.ndarray:
    """k-means of a bounded sample in memory; an empty cell takes the vector that is farthest from its centroid."""
    if len(x) < k:
        raise ValueError(f"{k} centroids, but only {len(x)} training rows")
    c = x[np.sort(np.random.default_rng(seed).choice(len(x), k, replace=False))].copy()
    for _ in range(steps):
        lists, dist = nearest_lists(x, c, 1)
        lists, dist = lists[:, 0], dist[:, 0]
        n = np.bincount(lists, minlength=k)
        sums = np.stack([np.bincount(lists, v, k) for v in x.T], axis=1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        empty = np.flatnonzero(n == 0)
        c[empty] = x[np.argsort(-dist, kind="stable")[: len(empty)]]
    return c
