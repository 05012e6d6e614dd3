"""Packed rows that tasks compare, and models of a fixed size kept as Parquet."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions import kernels


SPREAD = 4


def nearest_lists(x: np.ndarray, centroids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, n) numbers of the nearest centroids and their exact squared distances; ties go to the smaller number."""
    n = min(n, len(centroids))
    if n == 1 and len(x):
        lists, dist = _nearest_list(x, centroids)
        return lists[:, None], dist[:, None]
    lists, dist = np.empty((len(x), n), np.int64), np.empty((len(x), n))
    for at in range(0, len(x), 1024):
        part = x[at : at + 1024]
        i, j, v = kernels.block_topk("l2", centroids, part, n)
        order = np.lexsort((j, v, i))
        i, j, v = i[order], j[order], v[order]
        first = np.searchsorted(i, np.arange(len(part)))
        pick = first[:, None] + np.arange(n)[None, :]
        lists[at : at + 1024], dist[at : at + 1024] = j[pick], v[pick]
    return lists, dist


def _nearest_list(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """nearest_lists for one list: only rows with several centroids about as near are looked at again."""
    lists, twice, own = np.empty(len(x), np.int64), 2 * centroids.T, (centroids * centroids).sum(axis=1)
    for at in range(0, len(x), 1024):
        part = x[at : at + 1024]
        with np.errstate(invalid="ignore", over="ignore"):
            s = part @ twice
            s -= own
            top = s.argmax(axis=1)
            floor = s[np.arange(len(part)), top]
            room = 2 * kernels.NEAR * np.maximum(1.0, np.abs(floor) + (part * part).sum(axis=1))
            alone = np.count_nonzero(s >= (floor - room)[:, None], axis=1) == 1
        again = np.flatnonzero(~(alone & np.isfinite(floor)))
        if len(again):
            i, j, v = kernels.block_topk("l2", centroids, part[again], 1)
            order = np.lexsort((j, v, i))
            top[again] = j[order][np.searchsorted(i[order], np.arange(len(again)))]
        lists[at : at + 1024] = top
    return lists, kernels.exact("l2", centroids[lists], x)


def assigned(base: DataFrame, centroids: np.ndarray, vec: str = "embedding") -> DataFrame:
    """base with list_id, the nearest centroid. The centroids are broadcast; their number is a build parameter."""
    sent = base.sparkSession.sparkContext.broadcast(centroids)
    at = base.columns.index(vec)

    def run(batches):
        for b in batches:
            lists, _ = nearest_lists(kernels.matrix(b.column(at), sent.value.shape[1]), sent.value, 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists[:, 0].astype(np.int32))], [*b.schema.names, "list_id"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("list_id", T.IntegerType())]))


def packed(rows: DataFrame, size: int, fields: list[tuple[str, str, int]]) -> DataFrame:
    """Rows of (list_id, <fields> as binary): at most `size` rows of one list_id in each.

    fields: (column, NumPy type, components of each row, 0 for plain numbers). Sorted inside tasks only:
    a large list becomes many packed rows, wherever its rows are.
    """

    def seal(key, t):
        out = [pa.array([key], pa.int32())]
        for name, kind, width in fields:
            values = kernels.matrix(t[name], width) if width else t[name].to_numpy()
            out.append(pa.array([np.ascontiguousarray(values.astype(kind)).tobytes()], pa.binary()))
        return pa.RecordBatch.from_arrays(out, ["list_id", *(f[0] for f in fields)])

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows:
                keys = held["list_id"].to_numpy()
                n = min(size, int(np.searchsorted(keys != keys[0], True)))
                if n == held.num_rows and n < size:
                    break
                yield seal(int(keys[0]), held.slice(0, n))
                held = held.slice(n)
        if held is not None and held.num_rows:
            yield seal(int(held["list_id"][0].as_py()), held)

    names = [f[0] for f in fields]
    return rows.select("list_id", *names).sortWithinPartitions("list_id").mapInArrow(run, "list_id int, " + ", ".join(f"{n} binary" for n in names))


def by_list(lists: DataFrame) -> DataFrame:
    """Dealt by ranges of (list, id): a short list is whole in one task (and file), a long one is split over some."""
    return lists.repartitionByRange("list_id", "vec_id")


def pruned(lists: DataFrame, probes: DataFrame, some: bool) -> DataFrame:
    """Those lists that a query probes; where they lie in folders, the others are not read. The driver gets no more numbers than there are lists."""
    if not some:
        return lists
    wanted = [r[0] for r in probes.select("list_id").distinct().collect()]
    return lists.where(F.col("list_id").isin(wanted))


def meeting(tiles: DataFrame, blocks: DataFrame, spread: int) -> DataFrame:
    """Tiles and blocks of the same list; a list's tiles are dealt out to `spread` tasks, its blocks go to each of them.

    Neither side is broadcast: blocks hold each query once for each probed list and task, too much to go through the driver.
    """
    tiles = tiles.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(spread)).cast("int"))
    blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return tiles.join(blocks.hint("merge"), ["list_id", "part"])


def probed(queries: DataFrame, centroids: np.ndarray, nprobe: int, rotation: np.ndarray | None = None) -> DataFrame:
    """(query_id, list_id, q): one row for each query and list that it looks into."""
    sent = queries.sparkSession.sparkContext.broadcast((centroids, rotation))

    def run(batches):
        c, r = sent.value
        for b in batches:
            q = kernels.matrix(b.column(1), c.shape[1])
            if r is not None:
                q = q @ r.T
            lists, _ = nearest_lists(q, c, nprobe)
            n = lists.shape[1]
            rep = np.repeat(np.arange(len(q)), n)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rep)), pa.array(lists.ravel().astype(np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(q[rep].ravel()), q.shape[1]).cast(pa.list_(pa.float64()))], ["query_id", "list_id", "q"])

    return queries.select(F.col("query_id").cast("long"), F.col("q").cast("array<double>")).mapInArrow(run, "query_id long, list_id int, q array<double>")


def save_model(spark: SparkSession, model: dict[str, np.ndarray], path: str) -> None:
    rows = [(k, [int(x) for x in v.shape], str(v.dtype), np.ascontiguousarray(v).tobytes()) for k, v in model.items()]
    spark.createDataFrame(rows, "name string, shape array<long>, dtype string, data binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {r["name"]: np.frombuffer(bytes(r["data"]), r["dtype"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}
