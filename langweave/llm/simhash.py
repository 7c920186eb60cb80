"""Near duplicates by SimHash: pivot distance tables, and groups of linked fingerprints.

Every document gets a 64-bit fingerprint of its word shingles. Equal fingerprints are one point. Each point carries
its Hamming distances to fixed reference fingerprints (pivots); two points cannot be closer than the largest
difference of their coordinates, so a pair beyond the limit in any coordinate is discarded before it is verified.

Which pairs are compared at all follows from the pigeonhole principle: the 64 bits are cut into blocks, and points
within ``max_distance`` agree on all but so many blocks. A point is filed under every choice of that many blocks, and
only points of one file meet. No pair within the limit is missed, and none outside a file is formed.

A large group of near copies would still make a file with all its pairs. So the points of each file are first held
against a few centres of the file, at a cost linear in its size, and the components found that way are contracted. Of
each file only the points outside its smallest component are then compared with the rest, and only pairs of different
components: what one pass has joined needs no second link.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from langweave.llm.batches import text_rows
from langweave.llm.columns import unclashed, whole
from langweave.llm.components import connected_components
from langweave.scratch import materialize, small_side

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
HASH_SEED = 42
# Bits of this many shingles are counted at a time.
COUNT_BLOCK = 1 << 14
# Reference fingerprints: successive xxHash64 values, so any number of them can be had.
PIVOTS = 8
CENTRES = 3
# So many ids to drop are broadcast, if they also fit the bound in bytes; beyond it a plain join is planned.
MAX_BROADCAST_IDS = 1_000_000


def text_fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """A bit is 1 if it is set in over half of the hashes of the shingles (repeats included); no words: zero."""
    # Of bytes, lower() changes A-Z only and split() knows the six ASCII white space characters only.
    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = list(itertools.accumulate(len(t) + 1 for t in tokens))
    starts = [0, *ends[:-1]]
    size = min(shingle_words, len(tokens))
    digest, total, ones = xxhash.xxh64_intdigest, len(tokens) - size + 1, np.zeros(64, np.int64)
    for at in range(0, total, COUNT_BLOCK):
        stop = min(at + COUNT_BLOCK, total)
        hashes = np.fromiter(
            (digest(line[starts[i] : ends[i + size - 1] - 1], HASH_SEED) for i in range(at, stop)), np.uint64, stop - at
        )
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str, doc_id: str, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``id, fingerprint`` (a signed long) of every row; a null text counts as empty."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_fingerprint(t.as_py(), shingle_words) for t in batch.column("text")]
            yield pa.record_batch([batch.column("id"), pa.array(found, pa.int64())], names=["id", "fingerprint"])

    kind = docs.schema[doc_id].dataType.simpleString()
    texts = text_rows(docs.select(F.col(doc_id).alias("id"), whole(text).alias("text")))
    return texts.mapInArrow(
        fold, f"id {kind}, fingerprint bigint"
    )


def blocks_for(points: int, max_distance: int = MAX_DISTANCE) -> int:
    """Into how many blocks to cut the fingerprint: enough that a file of unrelated points stays small.

    Each block more makes keys longer and files more numerous; every choice finds the same links.
    """
    blocks = max_distance + 2
    while blocks < 16 and points > 8 << (64 * (blocks - max_distance) // blocks):
        blocks += 1
    return blocks


def _cuts(blocks: int) -> list[int]:
    return [64 * k // blocks for k in range(blocks + 1)]


def _block(value: Column, low: int, high: int) -> Column:
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << (high - low)) - 1))


def filed(points: DataFrame, blocks: int, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Every point under each choice of ``blocks - max_distance`` blocks: adds ``file`` and ``key``."""
    cuts, entries = _cuts(blocks), []
    for number, chosen in enumerate(itertools.combinations(range(blocks), blocks - max_distance)):
        key, used = F.lit(0).cast("long"), 0
        for b in chosen:
            key = key.bitwiseOR(F.shiftleft(_block(F.col("fingerprint"), cuts[b], cuts[b + 1]), used))
            used += cuts[b + 1] - cuts[b]
        entries.append(F.struct(F.lit(number).alias("file"), key.alias("key")))
    return points.select("*", F.inline(F.array(*entries)))


def pivot_coordinates(fingerprint: Column, pivots: int = PIVOTS) -> list[Column]:
    """The distance table: Hamming distances to the reference fingerprints."""
    return [
        F.bit_count(fingerprint.bitwiseXOR(F.xxhash64(F.lit(k)))).cast("byte").alias(f"pivot{k}") for k in range(pivots)
    ]


def _near(left: str, right: str, max_distance: int, pivots: int = PIVOTS) -> Column:
    """Not excluded by any pivot, and verified."""
    near = F.lit(True)
    for k in range(pivots):
        near &= F.abs(F.col(f"{left}.pivot{k}").cast("int") - F.col(f"{right}.pivot{k}")) <= max_distance
    return near & (F.bit_count(F.col(f"{left}.fingerprint").bitwiseXOR(F.col(f"{right}.fingerprint"))) <= max_distance)


def links_to_centres(points: DataFrame, blocks: int, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Links ``a, b`` between the points of each file and a few of its points.

    A centre is the point that comes first once all are combined with a seed's reference fingerprint, an order that
    partial aggregation can keep as one long.
    """
    entries = filed(points, blocks, max_distance)
    turned = [F.xxhash64(F.lit(f"centre {seed}")) for seed in range(CENTRES)]
    firsts = [F.min(F.col("fingerprint").bitwiseXOR(t)).bitwiseXOR(t) for t in turned]
    chosen = entries.groupBy("file", "key").agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.array(*firsts)).alias("c"))
    centres = chosen.filter("n > 1").select("file", "key", F.explode("c").alias("fingerprint"))
    centres = materialize(centres.select("*", *pivot_coordinates(F.col("fingerprint"))), "centres")
    same_file = (F.col("p.file") == F.col("c.file")) & (F.col("p.key") == F.col("c.key"))
    apart = F.col("p.fingerprint") != F.col("c.fingerprint")
    return entries.alias("p").join(centres.alias("c"), same_file & apart & _near("p", "c", max_distance)).select(
        F.col("p.fingerprint").alias("a"), F.col("c.fingerprint").alias("b")
    )


def links_between_components(points: DataFrame, blocks: int, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Links between points of different ``component`` that share a file.

    Two points of different components are not both in the file's smallest one, so one side is only the rest.
    """
    entries = filed(points, blocks, max_distance)
    mixed = entries.groupBy("file", "key").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    mixed = materialize(mixed.filter("least < most").drop("most"), "mixed-files")
    open_entries = materialize(entries.join(mixed, ["file", "key"]), "open-entries")
    left, right = open_entries.filter("component != least").alias("p"), open_entries.alias("q")
    pair = (
        (F.col("p.file") == F.col("q.file"))
        & (F.col("p.key") == F.col("q.key"))
        & (F.col("p.component") != F.col("q.component"))
        & ((F.col("q.component") == F.col("q.least")) | (F.col("p.fingerprint") < F.col("q.fingerprint")))
    )
    return left.join(right, pair & _near("p", "q", max_distance)).select(
        F.col("p.fingerprint").alias("a"), F.col("q.fingerprint").alias("b")
    )


def simhash_groups(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    shingle_words: int = SHINGLE_WORDS,
    max_distance: int = MAX_DISTANCE,
) -> DataFrame:
    """One row per row of ``docs``: its id, ``fingerprint`` (a long) and ``component_id``, the smallest id reachable
    over links of at most ``max_distance`` differing bits, itself included.

    Texts without words, null or empty, have fingerprint zero and are linked like any other. Repeated rows share a
    fingerprint. A null id takes part in linking, and gets the component of its fingerprint (null if all its ids are).
    Empty tables give an empty result. Other columns of ``docs`` are not read; ``keep_first`` keeps them.
    """
    prints = materialize(fingerprints(docs, text, doc_id, shingle_words), "fingerprints")
    points = prints.groupBy("fingerprint").agg(F.min("id").alias("first_id"))
    points = materialize(points.select("*", *pivot_coordinates(F.col("fingerprint"))), "points")
    blocks = blocks_for(points.count(), max_distance)
    first_links = materialize(links_to_centres(points, blocks, max_distance).distinct(), "first-links")
    first = connected_components(first_links).withColumnRenamed("node", "fingerprint")
    labelled = points.join(first, "fingerprint", "left").withColumn(
        "component", F.coalesce("component", "fingerprint")
    )
    labelled = materialize(labelled, "labelled-points")
    rest = materialize(links_between_components(labelled, blocks, max_distance).distinct(), "further-links")
    linked = connected_components(first_links.unionByName(rest)).withColumnRenamed("node", "fingerprint")
    members = materialize(
        points.select("fingerprint", "first_id").join(linked, "fingerprint", "left").withColumn(
            "component", F.coalesce("component", "fingerprint")
        ),
        "members",
    )
    heads = materialize(members.groupBy("component").agg(F.min("first_id").alias("component_id")), "heads")
    named = materialize(members.join(heads, "component").select("fingerprint", "component_id"), "named-points")
    return prints.join(named, "fingerprint").select(F.col("id").alias(doc_id), "fingerprint", "component_id")


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with ``fingerprint``, ``component_id`` and ``kept``: the row with its component's smallest id stays.

    Ids must be unique to keep one row a component; repeated rows of the smallest id stay together.
    """
    docs = unclashed(docs, "fingerprint", "component_id", "kept")
    found = materialize(simhash_groups(docs, text, doc_id, **options).distinct(), "simhash-groups")
    found = found.withColumnRenamed(doc_id, "_id")
    joined = docs.join(found, F.col(doc_id).eqNullSafe(F.col("_id"))).drop("_id")
    return joined.withColumn("kept", F.col(doc_id).eqNullSafe(F.col("component_id")))


def without_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that ``keep_first`` marks as kept, unchanged.

    Only the ids to drop meet the rows, so texts stay in place while those ids are few enough to be broadcast. An id that
    stands for its component in one of its rows stays with all of them. Null ids stay where their component has no id.
    """
    stays = F.max(F.col(doc_id).eqNullSafe(F.col("component_id")))
    dropped = simhash_groups(docs, text, doc_id, **options).groupBy(doc_id).agg(stays.alias("_stays"))
    gone = small_side(dropped.filter("not _stays").select(F.col(doc_id).alias("_gone")), MAX_BROADCAST_IDS)
    return docs.join(gone, F.col(doc_id).eqNullSafe(F.col("_gone")), "left_anti")
