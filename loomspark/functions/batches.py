"""How much a Python worker is given at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch that goes to Python; a longer text is a batch of its own.
BYTES = 1 << 20
_KEY, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", (str(64 << 20), f"{64 << 20}b", "64m", "64MB")


def small(spark: SparkSession | None = None) -> None:
    """Batches of about BYTES from now on, so that a worker's memory does not grow with its partition.

    Spark reads that setting when a plan runs, so it stays for the session, unless the session has chosen another than Spark's own.
    """
    spark = spark or SparkSession.active()
    if spark.conf.get(_KEY, _DEFAULT[0]) in _DEFAULT:
        spark.conf.set(_KEY, str(BYTES))
