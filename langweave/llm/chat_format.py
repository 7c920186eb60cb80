"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own.

A conversation is formatted once, as the string of its turns one after the other. The example of an assistant turn is
a prefix of that string: all preceding turns as context, then the reply, and only the reply's text is trainable. So
``examples`` stores each as places in the conversation's string, which stays linear in the turns where written-out
contexts would grow with their square; ``example_texts`` writes them out for the examples it is given.

Turn: ``<|turn|>role<|text|>text<|end|>``. In roles and texts a backslash is doubled and one is put after the first
character of every control string, the marks above as well as ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]``; that can be undone
without doubt, because a put-in backslash never precedes another one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from langweave.llm.batches import text_rows
from langweave.llm.columns import whole
from langweave.scratch import materialize

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
TRAINED_ROLE = "assistant"
CONTROL = re.compile(r"([<\[])(?=\||/?s>|/?INST\])")
ESCAPED = re.compile(r"\\(\\?)")
FORMATTED = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.DOTALL)

FORMATTED_FIELDS = [
    StructField("position", LongType()),
    StructField("formatted", StringType()),
    *[StructField(name, LongType()) for name in ("start", "end", "target_start", "target_end")],
]
DIGEST_FIELDS = [
    StructField("n_turns", LongType()),
    StructField("turns_sha256", StringType()),
    StructField("loss_chars", LongType()),
    StructField("loss_sha256", StringType()),
    StructField("formatted_chars", LongType()),
]


def record_batch(rows: list[tuple], fields: list[StructField], first: pa.DataType) -> pa.RecordBatch:
    """Rows as Arrow; ``first`` is the type of the first field, which is passed through."""
    kinds = [first, *[pa.int64() if isinstance(f.dataType, LongType) else pa.string() for f in fields[1:]]]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.name for f in fields])


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text begins and ends in it."""
    head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn; raises if it isn't exactly one."""
    found = FORMATTED.fullmatch(formatted)
    if not found:
        raise ValueError("not a formatted turn")
    return unescape(found[1]), unescape(found[2])


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per turn of ``turns`` (``conv_id, turn, role, text``): ``conv_id, position, formatted, start, end,
    target_start, target_end``.

    ``position`` counts the conversation's turns from 0, ordered by turn (nulls first), then role and text; ``start``
    and ``end`` are the turn's place in the conversation's string, in code points. An assistant turn has the place of its
    text as target; for other turns it is null. Null roles and texts are empty. A null conv_id is a conversation.
    Repeated rows are turns of their own. Empty tables give an empty result. Other columns are not read.

    Conversations are dealt to tasks by id and streamed in order: a task holds one batch of turns, however long a
    conversation is.
    """
    fields = [turns.schema["conv_id"], *FORMATTED_FIELDS]
    ordered = turns.select("conv_id", "turn", whole("role").alias("role"), whole("text").alias("text"))
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, position, start = object(), 0, 0
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["conv_id"] != last:
                    last, position, start = row["conv_id"], 0, 0
                formatted, low, high = format_turn(row["role"], row["text"])
                target = (start + low, start + high) if row["role"] == TRAINED_ROLE else (None, None)
                rows.append((last, position, formatted, start, start + len(formatted), *target))
                position, start = position + 1, start + len(formatted)
            yield record_batch(rows, fields, batch.schema.field("conv_id").type)

    return text_rows(ordered).mapInArrow(fold, StructType(fields))


def examples(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn: ``conv_id, example, context_end, target_start, target_end, example_end``.

    The example is the first ``example_end`` code points of the conversation's string; of these only the target is
    trainable. ``example`` is the position of the reply.
    """
    return formatted.filter("target_start is not null").select(
        "conv_id",
        F.col("position").alias("example"),
        F.col("start").alias("context_end"),
        "target_start",
        "target_end",
        F.col("end").alias("example_end"),
    )


def example_texts(formatted: DataFrame, wanted: DataFrame) -> DataFrame:
    """The examples in ``wanted`` (``conv_id, example``) written out: ``conv_id, example, text`` and the target's place.

    As long as all their contexts together; meant for as many examples as a training batch asks for.
    """
    prefix = wanted.select(F.col("conv_id").alias("_conv"), "example").distinct()
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("position") <= F.col("example"))
    parts = formatted.join(prefix, same)
    return parts.groupBy("conv_id", "example").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("position", "formatted"))), lambda p: p["formatted"]), ""
        ).alias("text"),
        F.max(F.when(F.col("position") == F.col("example"), F.col("target_start"))).alias("target_start"),
        F.max(F.when(F.col("position") == F.col("example"), F.col("target_end"))).alias("target_end"),
    )


def read_digests(formatted: DataFrame, expanded: DataFrame) -> DataFrame:
    """Per conversation, from its formatted turns and the targets of its examples alone: ``conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars``."""
    fields = [formatted.schema["conv_id"], *DIGEST_FIELDS]
    targets = expanded.select(F.col("conv_id").alias("_conv"), "example", "target_start", "target_end")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("position") == F.col("example"))
    read = formatted.drop("target_start", "target_end").join(targets, same, "left").drop("_conv", "example")
    ordered = read.repartition("conv_id").sortWithinPartitions("conv_id", "position")

    def finished(conv, state) -> tuple:
        return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, kind = object(), None, None
        for batch in batches:
            done, kind = [], batch.schema.field("conv_id").type
            for row in batch.to_pylist():
                if row["conv_id"] != last:
                    if state:
                        done.append(finished(last, state))
                    last, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_turn(row["formatted"])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if row["target_start"] is not None:
                    low, high = (row[c] - row["start"] for c in ("target_start", "target_end"))
                    target = unescape(row["formatted"][low:high])
                    state[2] += len(target)
                    state[3].update(target.encode())
                state[4] += len(row["formatted"])
            yield record_batch(done, fields, kind)
        if state:
            yield record_batch([finished(last, state)], fields, kind)

    return text_rows(ordered).mapInArrow(fold, StructType(fields))


def written(turns: DataFrame) -> DataFrame:
    """The formatted conversations, written to the shared folder and read back."""
    return materialize(format_conversations(turns), "formatted-turns")
