"""Exact duplicates by two passes over a Bloom filter.

The first pass counts how many rows set each bit of a two-hash Bloom filter and keeps, as bitmaps, the bits set twice
or more. The second pass tests every row inside the row: one of whose bits was set by it alone has no equal and passes
straight through. Only the rest shuffle, on the digest of their text; false positives come out as groups of one.

The bitmaps are broadcast. They hold at most ``MAX_FILTER_BITS`` / 8 bytes (32 MB), whatever the input. Past some
sixteen million rows the filter of that size fills up gradually and more rows shuffle; the result stays exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from langweave.llm.columns import SPACE_RUN, unclashed, whole
from langweave.scratch import computed_once, materialize

BITS_PER_ROW = 16
MIN_FILTER_BITS = 1 << 20
MAX_FILTER_BITS = 1 << 28
KEEP_COLUMNS = ("keep_id", "group_size", "kept", "text_sha256")


def normalized(text: str) -> Column:
    """The text with every run of white space as one space; null as empty."""
    return F.regexp_replace(whole(text), SPACE_RUN, " ")


def filter_bits(rows: int) -> int:
    """Bits of the filter for so many rows: a power of two, at least 16 a row up to the bound."""
    wanted = 1 << (BITS_PER_ROW * max(rows, 1) - 1).bit_length()
    return min(max(wanted, MIN_FILTER_BITS), MAX_FILTER_BITS)


def _positions(digest: Column, bits: int) -> list[Column]:
    """Two bit positions, from different digits of the digest (15 hexadecimal digits fit a long)."""
    return [
        F.pmod(F.conv(F.substring(digest, start, 15), 16, 10).cast("long"), F.lit(bits)) + 1 for start in (1, 16)
    ]


def repeated_bits(digests: DataFrame, bits: int) -> DataFrame:
    """First pass: ``bucket, bitmap`` of the filter bits that two or more rows set (32 768 bits a row)."""
    set_bits = digests.select(F.explode(F.array(*_positions(F.col("text_sha256"), bits))).alias("bit"))
    often = set_bits.groupBy("bit").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return often.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap")
    )


def _is_set(bitmap: Column, bit: Column) -> Column:
    """Does the bitmap hold the bit? A missing bitmap holds none."""
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(bitmap, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def maybe_repeated(rows: DataFrame, bitmaps: DataFrame, bits: int) -> DataFrame:
    """Second pass: add ``_maybe``, false only where no other row has an equal text."""
    for k, position in enumerate(_positions(F.col("text_sha256"), bits)):
        side = bitmaps.select(F.col("bucket").alias(f"_bucket{k}"), F.col("bitmap").alias(f"_bitmap{k}"))
        rows = rows.withColumn(f"_bit{k}", position)
        rows = rows.join(F.broadcast(side), F.bitmap_bucket_number(f"_bit{k}") == F.col(f"_bucket{k}"), "left")
    hit = _is_set(F.col("_bitmap0"), F.col("_bit0")) & _is_set(F.col("_bitmap1"), F.col("_bit1"))
    return rows.withColumn("_maybe", hit).drop(*[f"_{c}{k}" for c in ("bucket", "bitmap", "bit") for k in (0, 1)])


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``keep_id`` (id of the row that stays), ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when identical after white space runs became one space; a null text equals an empty one. The
    smallest id of a group stays; null ids sort last, and a group of null ids only keeps a null ``keep_id``. Rows that
    share text and id are one document repeated: all of those with the smallest id are marked ``kept``. Empty tables
    give an empty result. Columns of ``docs`` named like an added one are replaced.
    """
    docs = unclashed(docs, *KEEP_COLUMNS, "_maybe")
    digested = computed_once(docs, "text_sha256", _digest(text))
    return _marked(digested, doc_id)


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The id and the added columns of ``exact_dedup`` alone, with the same results: every text is hashed once, and both
    passes read a written table of ids and digests."""
    digests = docs.select(F.col(doc_id), _digest(text).alias("text_sha256"))
    return _marked(materialize(digests, "digests"), doc_id)


def _digest(text: str) -> Column:
    return F.sha2(normalized(text).cast("binary"), 256)


def _marked(digested: DataFrame, doc_id: str) -> DataFrame:
    """Both passes over rows that carry ``text_sha256``."""
    columns = [c for c in digested.columns if c != "text_sha256"]
    bits = filter_bits(digested.count())
    bitmaps = materialize(repeated_bits(digested.select("text_sha256"), bits), "repeated-bits")
    tested = maybe_repeated(digested, bitmaps, bits)
    candidates = tested.filter("_maybe").drop("_maybe")
    # A written table leaves both sides of the join below as plain exchanges, which adaptive execution can split
    # where one text holds a large part of the rows.
    groups = materialize(
        candidates.groupBy("text_sha256")
        .agg(F.min(doc_id).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1"),
        "repeated-texts",
    )
    alone = tested.filter(~F.col("_maybe")).select(
        *columns,
        F.col(doc_id).alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keeper = F.when(F.col("group_size").isNull(), F.col(doc_id)).otherwise(F.col("keep_id"))
    grouped = candidates.join(groups, "text_sha256", "left").select(
        *columns,
        keeper.alias("keep_id"),
        size.alias("group_size"),
        keeper.eqNullSafe(F.col(doc_id)).alias("kept"),
        "text_sha256",
    )
    return alone.unionByName(grouped)
