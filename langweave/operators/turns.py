"""Chat turns as tables: request checking, generation requests and results, response records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from langweave.fixed_values import (
    FAILED_MESSAGE,
    FAILED_STATUS,
    GENERATOR_MODEL,
    GENERATOR_NAME,
    MAX_TOKENS,
    REJECT_MESSAGE,
    REJECT_STATUS,
    TEMPERATURE,
)
from langweave.functions.text import prompt_key, strip, strip_answer
from langweave.operators.lookups import prompt_lookup
from langweave.scratch import computed_once
from langweave.sources.corpora import to_json_keeping_nulls

# The part of a generation result that is used.
RESULT_SCHEMA = "choices array<struct<message struct<content string>>>"


def request_text(body: Column) -> Column:
    """The stripped ``text`` of a JSON request body; null for anything but a non-blank string."""
    field = F.try_variant_get(F.try_parse_json(body), "$.text", "variant")
    text = F.when(F.schema_of_variant(field) == "STRING", field.cast("string"))
    return F.nullif(strip(text), F.lit(""))


def check_requests(requests: DataFrame, body: str = "body") -> DataFrame:
    """Requests with their ``text``, null where it is missing.

    A body that names a key twice is not JSON here and is rejected; a lenient parser would take the last one.
    """
    return computed_once(requests, "text", request_text(F.col(body)))


def split_checked(checked: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Accepted rows with ``text``, and the ``columns`` of rejected rows with ``status`` and ``error``."""
    accepted = checked.filter(F.col("text").isNotNull())
    rejected = checked.filter(F.col("text").isNull()).select(
        *columns, F.lit(REJECT_STATUS).alias("status"), F.lit(REJECT_MESSAGE).alias("error")
    )
    return accepted, rejected


def validate_requests(requests: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected requests."""
    return split_checked(check_requests(requests, body), requests.columns)


def build_generation_requests(
    turns: DataFrame,
    key: str,
    text: str = "text",
    label: str = "label",
    script: str = "script",
    model: str = GENERATOR_MODEL,
    temperature: float = TEMPERATURE,
    max_tokens: int = MAX_TOKENS,
) -> tuple[DataFrame, DataFrame]:
    """``key, prompt_key, messages, model, temperature, max_tokens`` per turn, and the turns whose
    label has no prompt. The user text goes in stripped, not normalised."""
    keyed = turns.withColumn("prompt_key", prompt_key(F.col(label), F.col(script)))
    known, unknown = prompt_lookup(keyed)
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.col("system_prompt").alias("content")),
        F.struct(F.lit("user").alias("role"), strip(F.col(text)).alias("content")),
    )
    requests = known.select(
        key,
        "prompt_key",
        messages.alias("messages"),
        F.lit(model).alias("model"),
        F.lit(temperature).alias("temperature"),
        F.lit(max_tokens).alias("max_tokens"),
    )
    return requests, unknown


def write_generation_requests(requests: DataFrame, path: str) -> None:
    """JSON lines for an external batch run."""
    requests.write.json(path)


def parse_generation_results(results: DataFrame, key: str, body: str = "body") -> DataFrame:
    """``key, answer, generator_name``: the stripped content of the first choice."""
    first = F.get(F.from_json(F.col(body), RESULT_SCHEMA)["choices"], 0)
    return results.select(
        key,
        strip_answer(first["message"]["content"]).alias("answer"),
        F.lit(GENERATOR_NAME).alias("generator_name"),
    )


def assemble_turns(detections: DataFrame, generations: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``key`` and the nested response record of every answered turn, and the turns without a generation or with a
    null answer, with ``status`` and ``error``."""
    both = detections.join(generations, key, "left")
    joined = both.filter(F.col("answer").isNotNull())
    failed = both.filter(F.col("answer").isNull()).select(
        key, F.lit(FAILED_STATUS).alias("status"), F.lit(FAILED_MESSAGE).alias("error")
    )
    response = F.struct(
        "answer",
        "label",
        "scores",
        "confidence",
        F.struct("detect_ms", "generate_ms").alias("timings"),
        F.struct(F.col("detector_name").alias("detector"), F.col("generator_name").alias("generator")).alias("model"),
        "script",
        "prompt_key",
    )
    return joined.select(key, response.alias("response")), failed


def emit_responses(turns: DataFrame, key: str) -> DataFrame:
    """``key, body``: the response as JSON, a null script written as null."""
    return turns.select(key, to_json_keeping_nulls(F.col("response")).alias("body"))


def rounded_ms(seconds: Column) -> Column:
    return F.round(seconds * 1000, 1)


def turn_timings(turns: DataFrame, detect_ms: str = "detect_ms", generate_ms: str = "generate_ms") -> DataFrame:
    """Add ``total_ms``; a missing part counts as zero."""
    zero = F.lit(0.0)
    return turns.withColumn("total_ms", F.coalesce(detect_ms, zero) + F.coalesce(generate_ms, zero))
