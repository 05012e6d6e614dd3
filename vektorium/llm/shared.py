"""Checkpoints and small helpers of the operators in this subpackage."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import BATCH_BYTES, BATCH_KEY, small_batches  # noqa: F401  used as names of this module

HOT_KEYS = 10_000


def prepare(spark: SparkSession) -> None:
    """Make the checkpoint folder known.

    It is the one named in ``spark.checkpoint.dir``. Where that is unset, a local master
    (as in tests) gets a temporary folder; any other master is an error, since executors
    could not see a folder of the driver's machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    place = sc.getConf().get("spark.checkpoint.dir") or None
    if place is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        place = os.path.join(tempfile.gettempdir(), "checkpoints", "vektorium")
    sc.setCheckpointDir(place)


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings (dots as double underscores) that hold inside the block only."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, **more: str) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there.

    What its plan has shuffled is not needed any more then, so those files are removed at once
    and don't wait for the driver's garbage collection.
    """
    prepare(df.sparkSession)
    with settings(df.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", **more):
        return df.select("*").checkpoint(eager=True)


def cut_dealt(df: DataFrame, n: int, key: str) -> DataFrame:
    """Checkpoint df dealt by key into n partitions, sorted by it, so that later joins and cogroups by key don't move it again.

    The planner forgets how a checkpoint was dealt where adaptive execution made it, so that is off for this one job.
    """
    return cut(df.repartition(n, key).sortWithinPartitions(key), spark__sql__adaptive__enabled="false")


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scan_partitions(df: DataFrame) -> int:
    """How many partitions the plan of df has; for a scan this follows its bytes, and nothing runs."""
    with settings(df.sparkSession, spark__sql__adaptive__enabled="false"):
        return df.select("*").rdd.getNumPartitions()


class Slices:
    """Splits the hot keys of a join: keys with more than max(slice_rows, n_rows / HOT_KEYS) rows are cut into slices.

    sizes has the key columns and the column ``n`` of rows of each key; at most HOT_KEYS of its rows are broadcast.
    ``salt`` adds the slice to the many rows, ``repeat`` to the one row of each key; both are then joined by
    [*keys, "slice"]. Which slice a row gets does not matter.
    """

    def __init__(self, sizes: DataFrame, keys: list[str], n_rows: int, slice_rows: int):
        self.keys = keys
        n = F.ceil(F.col("n") / slice_rows).cast("int")
        self.hot = F.broadcast(sizes.where(F.col("n") > max(slice_rows, n_rows // HOT_KEYS)).select(*keys, n.alias("slices")))

    def salt(self, df: DataFrame) -> DataFrame:
        one = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("slices")).cast("int")
        return df.join(self.hot, self.keys, "left").withColumn("slice", F.coalesce(one, F.lit(0))).drop("slices")

    def repeat(self, df: DataFrame) -> DataFrame:
        every = F.sequence(F.lit(0), F.coalesce(F.col("slices") - 1, F.lit(0)))
        return df.join(self.hot, self.keys, "left").withColumn("slice", F.explode(every)).drop("slices")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever file system Spark finds it."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
