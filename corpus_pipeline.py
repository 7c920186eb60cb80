"""The training-corpus pipeline: stages that each take the documents their predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langweave.llm.exact_dedup import exact_dedup
from langweave.llm.packing import best_fit_packing
from langweave.llm.personal_data import masked, personal_data
from langweave.llm.quality_rules import quality_rules
from langweave.llm.simhash import without_near_copies
from langweave.scratch import materialize

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def passed_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule and read like the trusted ones.

    A null text is empty and fails the word count. Rows that share an id are judged each by its own text. Labels for ids
    that no document has count nothing. An empty table stays empty; columns beside those of documents are left out, and
    so in every later stage but the last.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs, labels).filter("kept").select(*DOCUMENT_COLUMNS)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id.

    Null texts equal empty ones. Repeated rows of the smallest id stay together; null ids go after all others.
    """
    return exact_dedup(docs).filter("kept").select(*DOCUMENT_COLUMNS)


def distinct_fingerprints(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id.

    Texts without words share a fingerprint, so one of them stays. An id that stands for its group stays with all of its
    rows; a null id stays only in a group without ids.
    """
    return without_near_copies(docs).select(*DOCUMENT_COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by masks, and its length anew.

    A null text stays null, with a null length. Overlapping finds become one mask, of the kind that begins first.
    Repeated rows stay repeated; each counts as evidence.
    """
    found = personal_data(docs).withColumn("text", masked("text", F.col("spans")))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences.

    A null or empty text is its end mark. Repeated rows and null ids are packed like others; equal lengths go in order
    of id and piece. An empty table gives no row.
    """
    return best_fit_packing(docs)


STAGES = [
    ("quality_rules", passed_rules),
    ("exact_dedup", distinct_texts),
    ("simhash_near_dedup", distinct_fingerprints),
    ("personal_data", without_personal_data),
    ("best_fit_packing", packed),
]
# The stages score, hash and pack in ways SQL has no words for; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, what each kept written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
