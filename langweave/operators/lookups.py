"""Label, prompt and display dictionaries joined onto tables of any size."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from langweave.fixed_values import LABEL_NAMES, RTL_LABELS, SYSTEM_PROMPTS
from langweave.scratch import small_side


def distinct_labels(df: DataFrame, label: str = "label_original") -> DataFrame:
    return df.select(label).distinct().orderBy(label)


def label_dictionary(df: DataFrame, label: str = "label_original") -> DataFrame:
    """``label, label_id`` with ids in sorted label order; null is no label.

    The window sees one row per distinct label, not the table.
    """
    labels = df.select(F.col(label).alias("label")).na.drop().distinct()
    return labels.withColumn("label_id", F.row_number().over(Window.orderBy("label")) - 1)


def label_encode(df: DataFrame, label: str = "label_original", dictionary: DataFrame | None = None) -> DataFrame:
    """Add ``label_id``; a label outside the dictionary gets null."""
    dictionary = label_dictionary(df, label) if dictionary is None else dictionary
    side = small_side(dictionary.select(F.col("label").alias("_label"), "label_id"))
    return df.join(side, F.col(label) == F.col("_label"), "left").drop("_label")


def label_decode(df: DataFrame, label_id: str, dictionary: DataFrame, out: str = "label") -> DataFrame:
    """Add the label of an id; an unknown id gets null."""
    side = small_side(dictionary.select(F.col("label_id").alias("_id"), F.col("label").alias(out)))
    return df.join(side, F.col(label_id) == F.col("_id"), "left").drop("_id")


def prompt_table(spark: SparkSession, prompts: Mapping[str, str] = SYSTEM_PROMPTS) -> DataFrame:
    return spark.createDataFrame(list(prompts.items()), "prompt_key string, system_prompt string")


def prompt_lookup(
    df: DataFrame, key: str = "prompt_key", prompts: Mapping[str, str] = SYSTEM_PROMPTS
) -> tuple[DataFrame, DataFrame]:
    """Rows with their ``system_prompt``, and the rows whose key has no prompt (an error)."""
    table = prompt_table(df.sparkSession, prompts).withColumnRenamed("prompt_key", "_key")
    side = F.broadcast(table)  # one row per prompt of a constant dictionary
    match = F.col(key) == F.col("_key")
    return df.join(side, match).drop("_key"), df.join(side, match, "left_anti")


def label_display(df: DataFrame, label: str = "label") -> DataFrame:
    """Add the display name (the label itself when it has none) and the right-to-left flag."""
    names = df.sparkSession.createDataFrame(list(LABEL_NAMES.items()), "_label string, _name string")
    named = df.join(F.broadcast(names), F.col(label) == F.col("_label"), "left")
    return named.select(
        *[df[c] for c in df.columns],
        F.coalesce("_name", label).alias("display_name"),
        F.coalesce(F.col(label).isin(*RTL_LABELS), F.lit(False)).alias("rtl"),
    )
