"""Python workers get texts in small Arrow batches, so that long texts don't meet in one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The longest texts are some hundred kilobytes, so a batch stays within some ten megabytes.
TEXT_ROWS = 256
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch for texts; a session that asks for fewer keeps its own number."""
    now = int(spark.conf.get(_ROWS, "10000"))
    if now <= 0 or now > TEXT_ROWS:
        spark.conf.set(_ROWS, str(TEXT_ROWS))


def text_rows(docs: DataFrame) -> DataFrame:
    """``docs``, with the session's batches made small."""
    small_batches(docs.sparkSession)
    return docs
