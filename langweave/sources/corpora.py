"""Reading, harmonising and writing text corpora."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from langweave.fixed_values import LANGID_CODES

UNIFIED_SCHEMA = StructType(
    [StructField(name, StringType()) for name in ("id", "text_raw", "label_original", "source")]
)
# Header CSV that keeps embedded newlines, doubled quotes and outer blanks as they are.
CSV_OPTIONS = {
    "header": True,
    "multiLine": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
# Records in a file of a written CSV: some tens of MB of texts of a few thousand characters.
CSV_ROWS = 10_000


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on whatever file system its scheme names."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def scan_parquet_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_multi_split(
    spark: SparkSession, splits: Sequence[str], codes: Sequence[str] = LANGID_CODES
) -> DataFrame:
    """All splits of a language-id corpus as one scan, restricted to the wanted languages."""
    return filter_langs(spark.read.parquet(*splits), codes)


def scan_csv_optional(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A header CSV, or no rows when the file is missing.

    The columns are those of the file; ``columns`` names them for the missing case only. All values
    are strings, so no inference pass over the file is needed. A record may span lines, so one file is
    read by one task: store a large corpus as a folder of files, as ``write_csv`` does.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], StructType([StructField(c, StringType()) for c in columns]))
    return spark.read.options(**CSV_OPTIONS).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of files of at most ``CSV_ROWS`` records each, so that no task reads more for a larger corpus."""
    df.write.options(**CSV_OPTIONS, maxRecordsPerFile=CSV_ROWS).csv(path)


def sink_parquet_if_absent(df: DataFrame, path: str) -> DataFrame:
    """Write once: an existing table wins over ``df``; either way the stored table is returned."""
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


def sink_splits(df: DataFrame, path: str, split: str = "split") -> DataFrame:
    """One folder per split, so that reading one split prunes the others.

    Every task writes its rows straight into the folders: no shuffle on the three split names, which
    would send the largest split through one task.
    """
    df.write.partitionBy(split).parquet(path)
    return df.sparkSession.read.parquet(path)


def filter_langs(df: DataFrame, codes: Sequence[str] = LANGID_CODES, column: str = "labels") -> DataFrame:
    """Keep the wanted language codes and upper-case them as labels."""
    return df.filter(F.col(column).isin(*codes)).withColumn(column, F.upper(column))


def project_source(df: DataFrame, source: str, label: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Harmonise one source to ``text_raw, label_original, source``.

    Column names vary between sources, so each rename applies only where the column is present.
    ``label`` sets a constant label; ``keep`` carries further columns (an ordering key, an id).
    """
    renamed = df.withColumnsRenamed(
        {"text": "text_raw", "label": "label_original", "labels": "label_original"}
    )
    label_column = F.lit(label) if label else F.col("label_original")
    return renamed.select(
        *keep,
        F.col("text_raw").cast("string").alias("text_raw"),
        label_column.cast("string").alias("label_original"),
        F.lit(source).alias("source"),
    )


def union_sources(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other)
    return out


def drop_null_text(df: DataFrame, column: str = "text_raw") -> DataFrame:
    return df.na.drop(subset=[column])


def to_json_keeping_nulls(record: Column) -> Column:
    """JSON text of a struct; null fields are written as ``null``, not left out."""
    return F.to_json(record, {"ignoreNullFields": "false"})
