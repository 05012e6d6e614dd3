"""Adding vectors from a stream to a saved index of inverted lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import IvfIndex
from ..operators.index.store import assigned, by_list, load_model


def append_to_ivf(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Each micro-batch goes to the lists of the index at `path`.

    A batch that is run again after a failure overwrites its own rows (folder ``batch=<id>`` below each
    list), so vectors are there once. trigger: as for ``writeStream.trigger``.
    """
    centroids = load_model(stream.sparkSession, f"{path}/model")["centroids"]

    def add(batch: DataFrame, number: int) -> None:
        rows = by_list(assigned(batch.select("vec_id", "embedding"), centroids)).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "list_id").parquet(f"{path}/stream")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def with_stream(spark, path: str) -> IvfIndex:
    """The saved index together with what streams have added."""
    index = IvfIndex.load(spark, path)
    added = spark.read.parquet(f"{path}/stream").select("vec_id", "embedding", F.col("list_id").cast("int"))
    return IvfIndex(index.centroids, index.lists.select("vec_id", "embedding", "list_id").unionByName(added))
