"""The registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langweave.llm import chat_format
from langweave.llm.exact_dedup import exact_groups
from langweave.llm.html_text import extract_text
from langweave.llm.packing import best_fit_packing
from langweave.llm.personal_data import KINDS, personal_data, span_list
from langweave.llm.pieces import MARKER, PieceModel, decode_pieces, encode_pieces
from langweave.llm.quality_classifier import classify, score_documents, train
from langweave.llm.quality_rules import COUNT_COLUMNS, quality_rules
from langweave.llm.simhash import simhash_groups
from langweave.llm.suffix_dedup import remove_repeats
from langweave.llm.token_files import read_checksums, write_token_files
from langweave.llm.turn_repair import repair_damaged
from langweave.llm.whitening import whitened_components
from langweave.scratch import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        vocabulary = file.read()
    return read_checksums(write_token_files(table(spark, sf_dir, "documents"), vocabulary))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *COUNT_COLUMNS, "base_failed", "kept", F.round("ratio", 6).alias("ratio"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # A conversation made of control strings goes with the given ones.
    tricky = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame(
        [(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string"
    )
    formatted = chat_format.written(turns.unionByName(added))
    return chat_format.read_digests(formatted, materialize(chat_format.examples(formatted), "chat-examples"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = PieceModel.from_file(public_tokenizers.path("piece_bpe_32k.model"))
    encoded = encode_pieces(table(spark, sf_dir, "documents"), model)
    # A literal marker in a text is decoded as the space it stands for.
    same = F.col("decoded") == F.translate("text", MARKER, " ")
    return decode_pieces(encoded, model).select("doc_id", "n_ids", "ids_crc32", same.alias("round_trip"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(score_documents(docs, train(docs, table(spark, sf_dir, "labels"))))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    return found.select(
        "doc_id",
        *[(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(span_list(base).cast("binary"), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(table(spark, sf_dir, "conversations"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_quality_rules": op2_quality_rules,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_html_text": op4_html_text,
    "op5_simhash": op5_simhash,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_chat_format": op7_chat_format,
    "op8_pieces": op8_pieces,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_personal_data": op10_personal_data,
    "op11_turn_repair": op11_turn_repair,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_whitening": op13_whitening,
}
