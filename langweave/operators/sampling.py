"""Seeded exact samples, splits and ranks.

Rows are ordered by ``md5(key:seed)`` with the key as tie-break, the same on every engine and for
every partitioning. Keys must be unique and not null; a null key, and a repeated one where that would change the
number of rows, is an error, not a loss.

No operator sends a whole label or source through one task. Rows are counted per hash prefix (a
partial aggregation of at most 16**4 prefixes per group), which gives the rank at which each prefix
starts. Cutting at given ranks then needs an exact ranking of the few rows that share a prefix with
a cut, and a pass that compares every row with the cut values, without a shuffle of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from langweave.fixed_values import SEED, SPLIT_RATIOS
from langweave.scratch import materialize, small_side

PREFIX_DIGITS = 4
# Keys that one task puts in order.
RANGE_ROWS = 1_000_000


def order_hash(key: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def _keyed(df: DataFrame, key: str, group: Column, seed: int) -> DataFrame:
    hashed = df.select(group.alias("_group"), F.col(key).alias("_key"))
    known = F.coalesce(order_hash(F.col("_key"), seed), F.raise_error(F.lit("null key in a seeded order")))
    hashed = hashed.withColumn("_hash", known)
    return hashed.withColumn("_prefix", F.substring("_hash", 1, PREFIX_DIGITS))


def _prefix_counts(keyed: DataFrame) -> DataFrame:
    """Rows per (group, prefix), the rank just before the prefix and the group size."""
    counts = keyed.groupBy("_group", "_prefix").agg(F.count("*").alias("_rows"))
    in_order = Window.partitionBy("_group").orderBy("_prefix")
    return counts.select(
        "_group",
        "_prefix",
        "_rows",
        (F.sum("_rows").over(in_order) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(Window.partitionBy("_group")).alias("_size"),
    )


def _cut_values(
    df: DataFrame, key: str, group: Column, ranks: Mapping[str, Column], seed: int, quotas: DataFrame | None = None
) -> DataFrame:
    """The (hash, key) found at each named rank of every group, and how many rows it reaches beyond the rank (none
    unless the key is repeated); a rank of 0 gives no row.

    ``ranks`` are expressions over ``_size``, the number of rows of the group, and ``_quota``, that of the group's row
    in ``quotas`` (``_of``, ``_quota``), where given.
    """
    keyed = _keyed(df, key, group, seed)
    counts = _prefix_counts(keyed)
    if quotas is not None:
        counts = counts.join(small_side(quotas), F.col("_group").eqNullSafe(F.col("_of"))).drop("_of")
    named = F.array(
        *[F.struct(F.lit(n).alias("name"), r.cast("long").alias("rank")) for n, r in ranks.items()]
    )
    cuts = (
        counts.select("*", F.inline(named).alias("_name", "_rank"))
        .filter((F.col("_before") < F.col("_rank")) & (F.col("_rank") <= F.col("_before") + F.col("_rows")))
        .select(
            F.col("_group").alias("_cut_group"),
            F.col("_prefix").alias("_cut_prefix"),
            "_name",
            (F.col("_rank") - F.col("_before")).alias("_nth"),
        )
    )
    near = keyed.join(
        small_side(cuts),
        F.col("_group").eqNullSafe(F.col("_cut_group")) & (F.col("_prefix") == F.col("_cut_prefix")),
    )
    # Counting per key first keeps a key that is repeated against the contract from piling up in one task.
    keys = near.groupBy("_group", "_name", "_nth", "_hash", "_key").agg(F.count("*").alias("_rows"))
    reached = F.sum("_rows").over(Window.partitionBy("_group", "_name").orderBy("_hash", "_key"))
    return (
        keys.withColumn("_reached", reached)
        .filter((F.col("_reached") - F.col("_rows") < F.col("_nth")) & (F.col("_nth") <= F.col("_reached")))
        .select(
            "_group",
            "_name",
            F.col("_hash").alias("_at_hash"),
            F.col("_key").alias("_at_key"),
            (F.col("_reached") - F.col("_nth")).alias("_beyond"),
        )
    )


def _up_to(hash_: Column, key: Column, at_hash: Column, at_key: Column) -> Column:
    """Whether a row lies at or before a cut; a missing cut lies before every row."""
    return F.coalesce((hash_ < at_hash) | ((hash_ == at_hash) & (key <= at_key)), F.lit(False))


def sample_exact(df: DataFrame, n: int, key: str, seed: int = SEED) -> DataFrame:
    """Exactly ``n`` rows without replacement when the table is larger, else the table itself.

    Two small aggregations find the hash value of the n-th row; the sample is then a plain filter. A key that is
    repeated at the cut leaves no exact sample and raises.
    """
    if n <= 0:
        return df.limit(0)
    cut = _cut_values(df, key, F.lit(0), {"n": F.when(F.col("_size") > n, F.lit(n))}, seed).first()
    if cut is None:
        return df
    if cut["_beyond"]:
        raise ValueError(f"key {cut['_at_key']!r} is repeated at the cut: no sample of exactly {n} rows")
    at_hash, at_key = F.lit(cut["_at_hash"]), F.lit(cut["_at_key"])
    return df.filter(_up_to(order_hash(F.col(key), seed), F.col(key), at_hash, at_key))


def stratified_split(
    df: DataFrame,
    key: str,
    label: str,
    ratios: Mapping[str, float] = SPLIT_RATIOS,
    seed: int = SEED,
) -> DataFrame:
    """Add ``split``: per label, the first 70 % of the seeded order train, the next 15 % valid, the
    rest test (quotas rounded down at each boundary). Null labels form a group of their own.

    The rows themselves are not shuffled: they meet one small row of cut values per label.
    """
    *cut_names, last = ratios
    ranks, cumulated = {}, 0
    for name in cut_names:
        cumulated += round(ratios[name] * 10_000)
        ranks[name] = F.floor(F.col("_size") * cumulated / 10_000)
    cuts = (
        _cut_values(df, key, F.col(label), ranks, seed)
        .groupBy("_group")
        .pivot("_name", cut_names)
        .agg(F.first("_at_hash").alias("hash"), F.first("_at_key").alias("key"))
    )
    hash_, key_column = order_hash(F.col(key), seed), F.col(key)
    split = F.lit(last)
    for name in reversed(cut_names):
        reached = _up_to(hash_, key_column, F.col(f"{name}_hash"), F.col(f"{name}_key"))
        split = F.when(reached, F.lit(name)).otherwise(split)
    joined = df.join(small_side(cuts), F.col(label).eqNullSafe(F.col("_group")), "left")
    return joined.select(*[df[c] for c in df.columns], split.alias("split"))


def exact_per_group(df: DataFrame, key: str, group: str, rows: Column, seed: int = SEED) -> DataFrame:
    """The first rows of every group in the seeded order, as many as ``rows`` says (an expression over ``_size``, the
    group's rows, ``_total``, those of all, and ``_least``, those of the smallest). Null groups are left out.

    Like the split, this compares rows with a cut value per group and shuffles none. Quotas are a table with a row for
    each group, joined with the counts and broadcast only if small; two numbers of all groups come to the driver.
    """
    known = df.filter(F.col(group).isNotNull())
    sizes = materialize(known.groupBy(F.col(group).alias("_of")).agg(F.count("*").alias("_size")), "group-sizes")
    whole = sizes.agg(F.sum("_size").alias("total"), F.min("_size").alias("least")).first()
    if whole["total"] is None:
        return known
    facts = sizes.withColumns({"_total": F.lit(whole["total"]), "_least": F.lit(whole["least"])})
    quotas = facts.select("_of", F.least(rows.cast("long"), F.col("_size")).alias("_quota"))
    cuts = _cut_values(known, key, F.col(group), {"n": F.col("_quota")}, seed, quotas)
    side = small_side(cuts.select(F.col("_group").alias("_of"), "_at_hash", "_at_key"))
    joined = known.join(side, F.col(group) == F.col("_of"))
    inside = _up_to(order_hash(F.col(key), seed), F.col(key), F.col("_at_hash"), F.col("_at_key"))
    return joined.filter(inside).select(*[known[c] for c in df.columns])


def seeded_positions(df: DataFrame, key: str, group: Column, seed: int = SEED) -> DataFrame:
    """``_group, _key, _position``: the 0-based place of every key in its group's seeded order.

    Keys and hashes alone are dealt out by ranges, as many as their number asks for, and written in order; the rows that
    lie before each range, a small table, make places in ranges places in the whole. A repeated key is an error.
    """
    spark = df.sparkSession
    keyed = _keyed(df, key, group, seed).select("_group", "_hash", "_key")
    ranges = max(spark.sparkContext.defaultParallelism, -(-keyed.count() // RANGE_ROWS))
    order = ["_group", "_hash", "_key"]
    placed = keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("_place", F.monotonically_increasing_id()), "seeded-order")
    twice = placed.groupBy(*order).count().filter("count > 1").first()
    if twice is not None:
        raise ValueError(f"key {twice['_key']!r} is repeated: its rows have no places of their own")
    # The upper bits of a place number its range; a group is without gaps within a range.
    parts = placed.groupBy("_group", F.shiftright("_place", 33).alias("_range")).agg(
        F.count("*").alias("_rows"), F.min("_place").alias("_first")
    )
    before = F.sum("_rows").over(Window.partitionBy("_group").orderBy("_range")) - F.col("_rows")
    starts = parts.select(
        F.col("_group").alias("_of"), F.col("_range").alias("_in"), (before - F.col("_first")).alias("_shift")
    )
    inside = F.col("_group").eqNullSafe(F.col("_of")) & (F.shiftright("_place", 33) == F.col("_in"))
    return placed.join(small_side(starts), inside).select(
        "_group", "_key", (F.col("_place") + F.col("_shift")).alias("_position")
    )


def assign_ids(df: DataFrame, prefix: str | Column, key: str, seed: int = SEED) -> DataFrame:
    """Add ``id`` = ``prefix_{position}``; rows of different prefixes are numbered apart, all in one go.

    Only keys are ranked. The rows meet the finished ids by prefix and key: they stay where they are while the ids are
    small enough to go to them, and are joined plainly beyond that.
    """
    group = F.lit(prefix) if isinstance(prefix, str) else prefix
    rows = df.withColumn("_prefix", group)
    places = seeded_positions(rows, key, F.col("_prefix"), seed)
    ids = small_side(
        places.select(
            F.col("_group").alias("_of"), F.col("_key").alias("_keyed"),
            F.concat("_group", F.lit("_"), F.col("_position").cast("string")).alias("id"),
        )
    )
    joined = rows.join(ids, (F.col("_prefix") == F.col("_of")) & (F.col(key) == F.col("_keyed")))
    return joined.select(*[c for c in df.columns if c.lower() != "id"], "id")
