"""Best-fit packing into sequences of several permitted lengths.

Documents are cut into pieces no longer than the largest permitted length. Pieces go, longest first, into the open bin
they fill most closely; where none has room a bin is opened, of the size that costs least for each token it can still
be expected to hold. Once a bin takes no more it is downsized to the smallest permitted length that holds its contents.

Pieces are dealt to packing groups by a hash of the document, its copy and the piece, so the bins of a group are made by
one task from a few ten thousand short rows (id, piece, length), sorted, however long a document or often repeated a row
is; texts are never moved. The share of space that a group of that size leaves empty is as small as that of all pieces
packed at once, and a lost task makes the same bins again.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from langweave.llm.columns import whole
from langweave.scratch import materialize

CAPACITIES = (512, 1024, 2048, 4096, 8192)
# What a sequence costs beside its tokens, in tokens: start of a kernel, padding to a tile, a row of the batch.
SEQUENCE_COST = 64
# Expected pieces of a packing group.
GROUP_PIECES = 20_000


def sequence_cost(capacity: int) -> int:
    return capacity + SEQUENCE_COST


class Bins:
    """The bins of one packing group; pieces must come longest first."""

    def __init__(self, capacities: Sequence[int], tokens: int):
        self.sizes = sorted(set(capacities))
        self.to_come = tokens
        self.used: list[int] = []
        self.room_of: list[tuple[int, int]] = []  # (room left, -bin) of open bins, ascending

    def _opened_size(self, length: int) -> int:
        """The permitted size with the least cost for a token, expecting it to take pieces of this length, as many as
        fit and are still to come."""
        fitting = [size for size in self.sizes if size >= length]
        return min(fitting, key=lambda size: (sequence_cost(size) / min(size // length * length, self.to_come), size))

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset of the next piece."""
        at = bisect.bisect_left(self.room_of, (length, -len(self.used)))
        if at < len(self.room_of):
            room, number = self.room_of.pop(at)
            number = -number
        else:
            room, number = self._opened_size(length), len(self.used)
            self.used.append(0)
        offset = self.used[number]
        self.used[number] += length
        self.to_come -= length
        if room > length:
            bisect.insort(self.room_of, (room - length, -number))
        return number, offset

    def final_size(self, number: int) -> int:
        """The smallest permitted size that holds the contents."""
        return self.sizes[bisect.bisect_left(self.sizes, self.used[number])]


def pack_group(lengths: Iterable[int], capacities: Sequence[int] = CAPACITIES) -> list[tuple[int, int, int, int]]:
    """For lengths in descending order: bin, offset, the bin's size and its contents' length."""
    lengths = list(lengths)
    bins = Bins(capacities, sum(lengths))
    placed = [bins.place(length) for length in lengths]
    return [(number, offset, bins.final_size(number), bins.used[number]) for number, offset in placed]


def lengths(docs: DataFrame, length: Column, doc_id: str) -> DataFrame:
    """``doc_id, tokens, copies``: rows of equal id and length are interchangeable, so only their number is kept."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.greatest(length, F.lit(0)).cast("long").alias("tokens"))
    return sized.filter("tokens > 0").groupBy("doc_id", "tokens").agg(F.count(F.lit(1)).alias("copies"))


def piece_count(largest: int) -> Column:
    """Into how many pieces a document of ``tokens`` is cut."""
    return F.floor((F.col("tokens") - 1) / largest) + 1


def pieces(sized: DataFrame, largest: int) -> DataFrame:
    """``doc_id, place, piece, piece_start, n_tokens``: every copy cut at multiples of the largest length; ``place`` is a
    hash of document, copy and piece."""
    none = F.lit(0).cast("long")
    copied = sized.select("doc_id", "tokens", F.explode(F.sequence(none, F.col("copies") - 1)).alias("copy"))
    cut = copied.select("*", F.explode(F.sequence(none, piece_count(largest) - 1)).alias("piece"))
    return cut.select(
        "doc_id",
        F.xxhash64("doc_id", "tokens", "copy", "piece").alias("place"),
        "piece",
        (F.col("piece") * largest).alias("piece_start"),
        F.least(F.lit(largest), F.col("tokens") - F.col("piece") * largest).alias("n_tokens"),
    )


def byte_tokens(text: str) -> Column:
    """Length in byte-level tokens: the UTF-8 bytes and one end mark; a null text is empty."""
    return F.octet_length(whole(text)) + 1


def best_fit_packing(
    docs: DataFrame,
    length: Column | None = None,
    doc_id: str = "doc_id",
    capacities: Sequence[int] = CAPACITIES,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, piece_start, n_tokens, bin_id, bin_offset, bin_size, bin_used``.

    ``length`` is the number of tokens of a row, by default the bytes of ``text`` and an end mark; a null or negative
    length, and one of zero, gives no piece. Bins are named ``group-number``; a bin never spans groups. Equal lengths
    go in order of id and piece. Repeated rows and null ids are packed like any other rows. Empty tables give an empty
    result. No other column of ``docs`` is read.
    """
    sizes = sorted(set(capacities))
    sized = materialize(lengths(docs, byte_tokens("text") if length is None else length, doc_id), "lengths")
    total = sized.agg(F.sum(F.col("copies") * piece_count(sizes[-1]))).first()[0] or 0
    groups = max(1, -(-total // group_pieces))
    cut = pieces(sized, sizes[-1])
    dealt = cut.withColumn("_group", F.pmod("place", F.lit(groups)).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task's rows are sorted by group; a group is complete when the next one begins.
        waiting, current = [], None
        for batch in batches:
            groups_of = batch.column("_group").to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(np.diff(groups_of)) + 1).tolist()] if len(groups_of) else []
            for start, stop in zip(starts, [*starts[1:], len(groups_of)]):
                if waiting and groups_of[start] != current:
                    yield finished(waiting, current)
                    waiting = []
                current = groups_of[start]
                waiting.append(batch.slice(start, stop - start))
        if waiting:
            yield finished(waiting, current)

    def finished(parts: list[pa.RecordBatch], group: int) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).select(["doc_id", "piece", "piece_start", "n_tokens"]).combine_chunks()
        placed = pack_group(rows.column("n_tokens").to_pylist(), sizes)
        names, *numbers = zip(*placed)
        rows = rows.append_column("bin_id", pa.array([f"{group}-{name}" for name in names], pa.string()))
        for name, values in zip(("bin_offset", "bin_size", "bin_used"), numbers):
            rows = rows.append_column(name, pa.array(values, pa.int64()))
        return rows.to_batches()[0]

    kind = cut.schema["doc_id"].dataType.simpleString()
    return (
        dealt.repartition(groups, "_group")
        .sortWithinPartitions("_group", F.desc("n_tokens"), "doc_id", "piece")
        .mapInArrow(
            pack,
            f"doc_id {kind}, piece long, piece_start long, n_tokens long, bin_id string, bin_offset long, "
            "bin_size long, bin_used long",
        )
    )
