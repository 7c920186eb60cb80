"""Shared-folder tables that cut lineage, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

CHECKPOINT_CONF = "spark.checkpoint.dir"
# A side is broadcast only when it has at most so many rows and bytes; beyond it a plain join is planned.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20


# Rows and bytes of an Arrow batch: a worker holds what it makes of a batch, several times as large, at a time.
ARROW_ROWS, ARROW_BYTES = 1024, 8 << 20
_ROWS_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach, named by the session.

    Only a local-mode session (one machine) may fall back to a temporary folder of its own.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="langweave-")
    return _local_folders[application]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/langweave-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, read_schema: StructType | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later jobs prune columns and push filters into the written table, and a lost executor costs a
    re-read, not a recomputation. ``read_schema`` reads the table back under other types (vectors).
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(read_schema or df.schema).parquet(path)


def _row_bytes(schema: StructType) -> Column:
    """About the bytes a row takes in memory: texts by their length, nested values by that of their JSON."""
    parts = [F.lit(16 * len(schema))]
    for field in schema:
        if isinstance(field.dataType, (StringType, BinaryType)):
            parts.append(F.coalesce(F.octet_length(field.name), F.lit(0)))
        elif isinstance(field.dataType, (ArrayType, MapType, StructType)):
            parts.append(F.octet_length(F.to_json(F.struct(field.name))))
    return reduce(lambda a, b: a + b, parts)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` ready to be the small side of a join: broadcast if its counted rows and bytes allow."""
    table = materialize(df, "small-side")
    size = table.agg(F.count("*").alias("rows"), F.sum(_row_bytes(table.schema).cast("long")).alias("bytes")).first()
    return F.broadcast(table) if size["rows"] <= max_rows and (size["bytes"] or 0) <= BROADCAST_BYTES else table


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches made small; a session that asks for fewer rows or bytes keeps its numbers.

    Rows alone bound no memory: a block of a fit is one row of about a megabyte.
    """
    spark = df.sparkSession
    now = int(spark.conf.get(_ROWS_CONF, "10000"))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(_ROWS_CONF, str(ARROW_ROWS))
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BYTES_CONF, "64m"))
    if size <= 0 or size > ARROW_BYTES:
        spark.conf.set(_BYTES_CONF, str(ARROW_BYTES))
    return df


def computed_once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Add a costly column through a one-element generator.

    A plain projection would be repeated in every filter and expression built on it; the optimizer
    does not copy an expression across a generator. The column is computed in a projection below the generator,
    because only a projection computes its own common parts once.
    """
    below = f"_{name}_once"
    return df.select("*", column.alias(below)).select("*", F.explode(F.array(below)).alias(name)).drop(below)
