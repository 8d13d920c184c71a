"""Batch size of what goes between Spark and Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Texts a Python task holds at once; Spark's own default would be ten thousand.
TEXTS_PER_BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """Texts can be long: keep the memory of Python workers, which outlive a stage, small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS_PER_BATCH))
