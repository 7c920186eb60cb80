"""Repair of conversation structure: the cheapest edits that make the roles alternate."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from langweave.llm.batches import text_rows
from langweave.scratch import materialize

# Roles so far, as states: nothing yet, the system's turn, the user's, the assistant's. The last one and the first end well.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
ENDS = (START, ASSISTANT)
# The state after a reply of the wanted role, and the states that a turn of each initial may follow.
WANTED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE_NAMES = {USER: "user", ASSISTANT: "assistant"}
FOLLOWS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL_PAIRS = ("su", "ua", "au")
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 1, 2, 5, 5
# A turn as one character: its role's initial (x: any other), a capital if truncated, a dot if it must go.
MUST_GO = "."
BLOCK_TURNS = 1024
SPACES = " \t\n\x0b\x0c\r"


# ---- the lattice ------------------------------------------------------------------------------

Label = tuple[int, str]
Node = tuple[int, int]


def _forward(turns: str, node: Node) -> Iterator[tuple[Node, int, str]]:
    place, state = node
    wanted = WANTED[state]
    yield (place, wanted), INSERT, "I"
    if place == len(turns):
        return
    turn = turns[place]
    yield (place + 1, state), DELETE, "D"
    if turn == MUST_GO:
        return
    extra = LEFT_TRUNCATED if turn.isupper() else 0
    after = FOLLOWS.get(turn.lower(), {}).get(state)
    if after is not None:
        yield (place + 1, after), extra, "K"
    yield (place + 1, wanted), extra + REROLE, "R"


def _backward(turns: str, node: Node) -> Iterator[tuple[Node, int, str]]:
    place, state = node
    before = [s for s in STATES if WANTED[s] == state]
    for earlier in before:
        yield (place, earlier), INSERT, "I"
    if place == 0:
        return
    turn = turns[place - 1]
    yield (place - 1, state), DELETE, "D"
    if turn == MUST_GO:
        return
    extra = LEFT_TRUNCATED if turn.isupper() else 0
    for earlier, after in FOLLOWS.get(turn.lower(), {}).items():
        if after == state:
            yield (place - 1, earlier), extra, "K"
    for earlier in before:
        yield (place - 1, earlier), extra + REROLE, "R"


def cheapest_edits(turns: str, entry: int = START, ends: Iterable[int] = ENDS) -> Label | None:
    """Cost and edits of the cheapest way from state ``entry`` before ``turns`` to one of ``ends`` after them.

    Dijkstra from both sides of the lattice (place, state). A label is a cost and the least string of edits that
    reaches the node at that cost: two such strings are never prefixes of each other, as further letters on the same
    turns would be insertions and cost more, so the least parts make the least whole. Steps without cost move by a
    turn, so of equal costs the node nearer to its side's start is settled first. The search stops when the two
    smallest open costs together exceed the best meeting; every way of that cost then crosses a node labelled by both
    sides, and the least concatenation of those decides. None if there is no way.
    """
    n = len(turns)
    sides = (
        ({(0, entry): (0, "")}, [(0, 0, entry)], set()),
        ({(n, end): (0, "") for end in ends}, [(0, 0, end) for end in sorted(ends)], set()),
    )
    best: Label | None = None
    while sides[0][1] and sides[1][1]:
        if best and sides[0][1][0][0] + sides[1][1][0][0] > best[0]:
            break
        side = 0 if sides[0][1][0][0] <= sides[1][1][0][0] else 1
        labels, heap, settled = sides[side]
        _, passed, state = heappop(heap)
        node = (passed if side == 0 else n - passed, state)
        if node in settled:
            continue
        settled.add(node)
        cost, edits = labels[node]
        steps = _forward(turns, node) if side == 0 else _backward(turns, node)
        for reached, price, letter in [(node, 0, ""), *steps]:
            label = (cost + price, edits + letter if side == 0 else letter + edits)
            if price or letter:
                if reached in settled or (reached in labels and labels[reached] <= label):
                    continue
                labels[reached] = label
                heappush(heap, (label[0], reached[0] if side == 0 else n - reached[0], reached[1]))
            if other := sides[1 - side][0].get(reached):
                whole = (label[0] + other[0], label[1] + other[1] if side == 0 else other[1] + label[1])
                best = whole if best is None else min(best, whole)
    return best


# ---- damage, faults and order -----------------------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the faults that crc32 of ``conv_id:turn`` modulo 20 deals out.

    0 drops the row, 1 empties its text, 2 removes its sentence marks, 3 repeats it, 4 gives it to the user. A null
    counts as one space, in that key as in role and text.
    """
    blank = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    fault = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    marks = text
    for mark in ".!?":
        marks = F.replace(marks, F.lit(mark), F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("_role"), text.alias("_text"), marks.alias("_bare"), fault.alias("_f"))
    return rows.filter("_f <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("_f") == 4, "user").otherwise(F.col("_role")).alias("role"),
        F.when(F.col("_f") == 1, "").when(F.col("_f") == 2, F.col("_bare")).otherwise(F.col("_text")).alias("text"),
        F.explode(F.when(F.col("_f") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def in_order(rows: DataFrame) -> DataFrame:
    """The rows written once in conversation order, with a ``place`` that rises with it over the whole table.

    Within a conversation rows go by turn (nulls first), then by the first characters of role and text, then by a
    digest of both, then as read. The order is dealt out by ranges of all these, so that a conversation of any share
    of the rows spreads over tasks; no key is longer than a few hundred bytes.
    """
    digest = F.sha2(F.concat_ws("\x00", "role", "text"), 256)
    keyed = rows.withColumn("digest", digest).withColumn("_read", F.monotonically_increasing_id())
    keys = ["conv_id", "turn", F.left("role", F.lit(64)), F.left("text", F.lit(64)), "digest", "_read"]
    placed = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_read")
    return materialize(placed.withColumn("place", F.monotonically_increasing_id()), "turns-in-order")


def faulty(rows: DataFrame) -> DataFrame:
    """The placed rows without texts: each with its role's initial and its first fault (blank, duplicate, truncated)."""
    seen = rows.groupBy("conv_id", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    bare = F.rtrim("text", F.lit(SPACES))
    slim = rows.select(
        "conv_id", "turn", "place", F.left("role", F.lit(1)).alias("initial"),
        (bare == "").alias("blank"), F.right(bare, F.lit(1)).isin(".", "!", "?").alias("ended"),
    )
    fault = (
        F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("ended"), "truncated")
    )
    return slim.join(seen, "place", "left").select("conv_id", "turn", "place", "initial", fault.alias("fault"))


def _symbol() -> Column:
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    return (
        F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO)
        .when(F.col("fault") == "truncated", F.upper(letter))
        .otherwise(letter)
    )


# ---- solving ----------------------------------------------------------------------------------

_WAYS = "conv_id long, block long, whole boolean, entry array<int>, leave array<int>, cost array<long>, edits array<string>"
_SOLVED = pa.schema(
    [
        ("conv_id", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), ("entry", pa.list_(pa.int32())),
        ("leave", pa.list_(pa.int32())), ("cost", pa.list_(pa.int64())), ("edits", pa.list_(pa.string())),
    ]
)
_CHAINED = pa.schema([("conv_id", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])


def _solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cheapest edits of whole conversations; of parts of longer ones, those from each state to each state."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["whole"]:
                ways = [(START, START, cheapest_edits(row["turns"]))]
            else:
                ways = [(i, o, cheapest_edits(row["turns"], i, (o,))) for i in STATES for o in STATES]
            ways = [(i, o, *label) for i, o, label in ways if label is not None]
            entry, leave, cost, edits = (list(part) for part in zip(*ways))
            out.append(
                {"conv_id": row["conv_id"], "block": row["block"], "whole": row["whole"], "entry": entry}
                | {"leave": leave, "cost": cost, "edits": edits}
            )
        yield pa.RecordBatch.from_pylist(out, schema=_SOLVED)


def _chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the parts of each conversation, which come in order: the best label of each state, part by part."""

    def ended(conv, labels):
        cost, audit = min(labels[s] for s in ENDS if s in labels)
        return pa.RecordBatch.from_pylist([{"conv_id": conv, "cost": cost, "audit": audit}], schema=_CHAINED)

    conv, labels = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if labels is None or row["conv_id"] != conv:
                if labels is not None:
                    yield ended(conv, labels)
                conv, labels = row["conv_id"], {START: (0, "")}
            after: dict[int, Label] = {}
            for i, o, cost, edits in zip(row["entry"], row["leave"], row["cost"], row["edits"]):
                if i in labels:
                    label = (labels[i][0] + cost, labels[i][1] + edits)
                    after[o] = min(after.get(o, label), label)
            labels = after
    if labels is not None:
        yield ended(conv, labels)


def audits(marked: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """``conv_id, cost, audit`` from the rows of ``faulty``.

    Rows are grouped in blocks of at most ``block_turns`` neighbours. A conversation within one block is solved there.
    Of a longer one every block is solved alone, from each state to each state; one streaming pass joins the blocks.
    """
    blocks = marked.groupBy("conv_id", F.expr(f"place div {block_turns}").alias("block")).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("place", _symbol().alias("s")))), lambda x: x["s"]), ""
        ).alias("turns")
    )
    counts = blocks.groupBy(F.col("conv_id").alias("_conv")).agg(F.count("*").alias("n"))
    blocks = blocks.join(counts, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "conv_id", "block", (F.col("n") == 1).alias("whole"), "turns"
    )
    solved = materialize(blocks.mapInArrow(_solve, _WAYS), "edit-ways")
    alone = solved.filter("whole").select("conv_id", F.col("cost")[0].alias("cost"), F.col("edits")[0].alias("audit"))
    parts = solved.filter("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return alone.unionByName(parts.mapInArrow(_chain, "conv_id long, cost long, audit string"))


# ---- applying the edits -----------------------------------------------------------------------

_REPAIRED = pa.schema([("conv_id", pa.int64()), ("illegal", pa.int64()), ("repaired_sha256", pa.string())])


def edited(turns: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """Role and text of the repaired turns: ``audit``'s edits applied to ``turns`` in order."""
    state = START
    for letter in audit:
        if letter == "I":
            state = WANTED[state]
            yield ROLE_NAMES[state], ""
            continue
        role, text = next(turns)
        if letter == "R":
            state = WANTED[state]
            yield ROLE_NAMES[state], text
        elif letter == "K":
            state = FOLLOWS[role[0]][state]
            yield role, text


def _apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each conversation, its audit first and then its rows in order: the digest of the repaired turns.

    Rows stream through; only the audit of the conversation at hand is held.
    """
    rows = ((r["conv_id"], r["place"], r["role"], r["text"]) for batch in batches for r in batch.to_pylist())
    row = next(rows, None)
    while row is not None:
        conv, _, _, audit = row
        illegal, last = 0, None
        following = None

        def turns(conv=conv):
            nonlocal illegal, last, following
            for found in rows:
                if found[1] == -1:
                    following = found
                    return
                if last is not None and last + found[2][:1] not in LEGAL_PAIRS:
                    illegal += 1
                last = found[2][:1]
                yield found[2], found[3]

        given = turns()
        digest, first = hashlib.sha256(), True
        for role, text in edited(given, audit):
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
        for _ in given:
            raise ValueError("more turns than edits")
        yield pa.RecordBatch.from_pylist(
            [{"conv_id": conv, "illegal": illegal, "repaired_sha256": digest.hexdigest()}], schema=_REPAIRED
        )
        row = following


def repaired_turns(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """``conv_id, illegal, repaired_sha256``: each conversation's audit and rows stream through one task in order."""
    heads = solved.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit("").alias("role"), F.col("audit").alias("text"))
    stream = heads.unionByName(rows.select("conv_id", "place", "role", "text"))
    ordered = text_rows(stream.repartition("conv_id").sortWithinPartitions("conv_id", "place"))
    return ordered.mapInArrow(_apply, "conv_id long, illegal long, repaired_sha256 string")


def repair_turns(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Faults, cheapest edits and repaired digest of each conversation of ``turns`` (conv_id, turn, role, text).

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256, a row for every
    conversation id of ``turns``; rows with a null id are one conversation. ``turns`` are taken as they are (see
    ``damaged`` for the query's damage); other columns are ignored. A null role or text counts as one space. Rows of
    one turn go by role and text; a repeated row is a duplicate. Role initials count, so that ``user`` and ``uncle``
    are alike and an empty or unknown role must be changed or deleted. A conversation whose turns are all null has no
    gaps. An empty table gives an empty result.
    """
    kept = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    rows = in_order(kept)
    marked = materialize(faulty(rows), "turn-faults")
    solved = materialize(audits(marked, block_turns), "turn-audits")
    counted = marked.groupBy("conv_id", "turn").agg(
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    )
    gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    counted = counted.groupBy("conv_id").agg(
        F.coalesce(gaps, F.lit(0)).alias("gaps"), *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")]
    )
    parts = counted.unionByName(solved, True).unionByName(repaired_turns(rows, solved), True)
    return parts.groupBy("conv_id").agg(
        *[F.max(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")]
    )


def repair_damaged(turns: DataFrame) -> DataFrame:
    """``repair_turns`` of the damaged rows; a conversation that lost all its rows has zeros and an empty audit."""
    found = repair_turns(damaged(turns).drop("copy")).unionByName(turns.select("conv_id").distinct(), True)
    whole = found.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in found.columns if c != "conv_id"])
    empty = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return whole.select(
        "conv_id",
        *[F.coalesce(c, F.lit(empty.get(c, 0))).alias(c) for c in whole.columns if c != "conv_id"],
    )
