"""Row filters and counts of the cleaning step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langweave.functions.text import NormalizeOptions, is_valid_text, normalize_text
from langweave.scratch import computed_once


def filter_valid_text(df: DataFrame, column: str = "text_raw") -> DataFrame:
    """Keep rows whose raw text is usable (letters of a URL count)."""
    return df.filter(is_valid_text(F.col(column)))


def filter_nonempty_norm(df: DataFrame, column: str = "text_norm") -> DataFrame:
    return df.filter(F.length(column) > 0)


def clean(df: DataFrame, options: NormalizeOptions = NormalizeOptions()) -> DataFrame:
    """Valid rows with their ``text_norm``, empty results dropped; one stage, no shuffle."""
    normalised = computed_once(filter_valid_text(df), "text_norm", normalize_text(F.col("text_raw"), options))
    return filter_nonempty_norm(normalised)


def row_funnel(df: DataFrame, options: NormalizeOptions = NormalizeOptions()) -> DataFrame:
    """Row counts raw (text not null), after validity, after normalisation, in one pass."""
    text = F.col("text_raw")
    valid = is_valid_text(text)
    return df.agg(
        F.count(text).alias("n_raw"),
        F.count_if(valid).alias("n_valid"),
        F.count_if(valid & (F.length(normalize_text(text, options)) > 0)).alias("n_normalised"),
    )


def source_counts(df: DataFrame, column: str = "source") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), column)


def split_report(df: DataFrame, column: str = "split") -> DataFrame:
    """Rows and share of the total per split; the total comes from the few grouped rows."""
    counts = df.groupBy(column).agg(F.count("*").alias("n_rows"))
    total = counts.agg(F.sum("n_rows").alias("total"))
    return counts.withColumn("share", F.col("n_rows") / total.scalar()).orderBy(column)
