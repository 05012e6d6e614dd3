"""Arrow batches bounded by bytes."""

from __future__ import annotations

from pyspark.sql import SparkSession

BATCH_BYTES = 2 << 20
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, where the session has no bound of its own.

    Rows alone don't bound them: 10,000 texts of 2 kB are 20 MB, which the JVM, its buffers and the Python worker each hold,
    and again with every array made from them. The bound stays, since it must hold when what a caller does with a frame is planned.
    """
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
