"""Silver labels by rule, gold samples for hand labelling, class balance, and post-processing of predictions.

Only names and thresholds of these steps are published; their meaning here is inferred from these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from langweave.fixed_values import (
    CS_RATIO_THRESHOLD,
    DIALECT_LABEL,
    GOLD_SAMPLES,
    LANGID_MIN_TOKENS,
    MIX_LABEL,
    MIX_MIN_TOKENS,
    SEED,
    SILVER_CONFIDENCE,
)
from langweave.functions.text import is_arabizi, ratios_of, script_counts
from langweave.operators.sampling import exact_per_group
from langweave.scratch import computed_once
from langweave.sources.corpora import scan_csv_optional, write_csv

GOLD_COLUMNS = ("id", "text_raw", "label")


def silver_label(counts: Column, ratios: Column, arabizi: Column, label: Column) -> Column:
    """``label, confidence`` by script: mixed, Arabic script, arabizi, Latin script, else null with its confidence.

    ``counts`` are those of ``script_counts``.

    Mixed text has tokens of both scripts and a code-switch share past the threshold. Otherwise Arabic script keeps an
    ``AR_`` label, arabizi among those is dialect, and Latin text of enough tokens keeps another label.
    """
    arab, latin, switched = (ratios[c] for c in ("arab_ratio", "latin_ratio", "cs_ratio"))
    mixed = (
        (counts["arab"] >= MIX_MIN_TOKENS)
        & (counts["latin"] >= MIX_MIN_TOKENS)
        & (switched >= CS_RATIO_THRESHOLD)
    )
    arabic_label = label.startswith("AR_")
    found = (
        F.when(mixed, F.lit(MIX_LABEL))
        .when(arabic_label & (arab > latin), label)
        .when(arabic_label & arabizi, F.lit(DIALECT_LABEL))
        .when(~arabic_label & (latin > arab) & (counts["tokens"] >= LANGID_MIN_TOKENS), label)
    )
    confidence = F.when(mixed, 2 * switched).otherwise(F.greatest(arab, latin))
    return F.struct(found.alias("label"), confidence.alias("confidence"))


def silver_labels(df: DataFrame, raw: str = "text_raw", norm: str = "text_norm", label: str = "label_original") -> DataFrame:
    """Add ``silver_label`` and ``silver_confidence`` to cleaned rows; a null label gets none but ``MIX``."""
    counted = computed_once(df, "_counts", script_counts(F.col(norm)))
    facts = F.struct(ratios_of(F.col("_counts")).alias("ratios"), is_arabizi(F.col(raw)).alias("izi"))
    known = computed_once(counted, "_facts", facts)
    found = silver_label(F.col("_counts"), F.col("_facts.ratios"), F.col("_facts.izi"), F.coalesce(label, F.lit("")))
    labelled = computed_once(known, "_silver", found)
    return labelled.select(
        *df.columns, F.nullif("_silver.label", F.lit("")).alias("silver_label"), F.col("_silver.confidence").alias("silver_confidence")
    )


def silver_filter(df: DataFrame, threshold: float = SILVER_CONFIDENCE) -> DataFrame:
    """Rows with a silver label that is sure enough."""
    return df.filter(F.col("silver_label").isNotNull() & (F.col("silver_confidence") >= threshold))


def gold_sample(df: DataFrame, key: str, label: str, n: int = GOLD_SAMPLES, seed: int = SEED) -> DataFrame:
    """A stratified sample: of each label its share of ``n`` rows, rounded up, in seeded order."""
    share = F.ceil(F.col("_size") * n / F.col("_total"))
    return exact_per_group(df, key, label, share, seed)


def write_gold_sample(sample: DataFrame, path: str) -> None:
    """The sample as a CSV for labelling by hand."""
    write_csv(sample, path)


def settled_labels(labelled: DataFrame) -> DataFrame:
    """``id, gold_label, votes, against`` for every id of hand-labelled rows (``id``, ``label``), a row each.

    Outer blanks of a label don't count, and a blank or null label is no vote. The label given most often wins; where
    several were given equally often, nobody has decided and ``gold_label`` is null. Rows are counted by id and label
    before they meet by id, so an id labelled very often costs a row for each of its labels.
    """
    given = labelled.select("id", F.trim("label").alias("label")).filter("id is not null and label <> ''")
    votes = given.groupBy("id", "label").agg(F.count("*").alias("votes"))
    # Of the most frequent labels the first and the last in order are the same where there is one only.
    top = votes.groupBy("id").agg(
        F.max("votes").alias("votes"),
        F.sum("votes").alias("all"),
        F.max_by("label", F.struct("votes", "label")).alias("last"),
        F.min_by("label", F.struct(-F.col("votes"), "label")).alias("first"),
    )
    label = F.when(F.col("first") == F.col("last"), F.col("first"))
    return top.select("id", label.alias("gold_label"), "votes", (F.col("all") - F.col("votes")).alias("against"))


def ingest_gold(df: DataFrame, path: str, key: str) -> DataFrame:
    """Rows whose key has a settled label in the labelled CSV, with ``gold_label``, one row for each row of ``df``.

    See ``settled_labels`` for blanks and conflicts; rows without a decision are left out. A missing file gives no rows.
    """
    labelled = settled_labels(scan_csv_optional(df.sparkSession, path, GOLD_COLUMNS)).filter("gold_label is not null")
    labelled = labelled.select(F.col("id").alias("_gold_id"), "gold_label")
    return df.join(labelled, F.col(key).cast("string") == F.col("_gold_id")).drop("_gold_id")


def rebalance_classes(df: DataFrame, key: str, label: str, seed: int = SEED) -> DataFrame:
    """Every class cut to the size of the smallest, in seeded order."""
    return exact_per_group(df, key, label, F.col("_least"), seed)


def postprocess_predictions(df: DataFrame, threshold: float = SILVER_CONFIDENCE) -> DataFrame:
    """Add ``final_label``: ``pred`` where its ``confidence`` reaches the threshold, else the silver label if any."""
    sure = F.coalesce(F.col("confidence") >= threshold, F.lit(False))
    return df.withColumn("final_label", F.when(sure, F.col("pred")).otherwise(F.coalesce("silver_label", "pred")))
