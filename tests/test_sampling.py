import hashlib

import pytest
from pyspark.sql import functions as F

from langweave.operators import sampling


def order(keys, seed=42):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{k}:{seed}".encode()).hexdigest(), k))


@pytest.fixture(scope="module")
def skewed(spark):
    """One label holds most rows; one is tiny; some labels are null."""
    label = (
        F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 8, F.lit(None)).when(F.col("id") < 60, "rare")
    ).otherwise("mid")
    return spark.range(3000).withColumn("label", label).withColumn("text", F.concat(F.lit("t"), "id")).cache()


def test_split_equals_plain_ranking(spark, skewed):
    out = sampling.stratified_split(skewed, "id", "label").collect()
    assert len(out) == 3000 and {r["text"] for r in out} == {f"t{i}" for i in range(3000)}
    groups = {}
    for row in out:
        groups.setdefault(row["label"], {})[row["id"]] = row["split"]
    assert set(groups) == {"hot", "mid", "rare", None}
    for members in groups.values():
        n = len(members)
        for rank, key in enumerate(order(members), 1):
            expected = "train" if rank * 20 <= n * 14 else "valid" if rank * 20 <= n * 17 else "test"
            assert members[key] == expected


def test_split_does_not_depend_on_partitions(spark, skewed):
    one = sampling.stratified_split(skewed.coalesce(1), "id", "label").select("id", "split")
    many = sampling.stratified_split(skewed.repartition(13), "id", "label").select("id", "split")
    assert one.exceptAll(many).count() == 0


def test_split_without_prefix_help(spark, skewed, monkeypatch):
    expected = {r["id"]: r["split"] for r in sampling.stratified_split(skewed, "id", "label").collect()}
    monkeypatch.setattr(sampling, "PREFIX_DIGITS", 1)
    assert {r["id"]: r["split"] for r in sampling.stratified_split(skewed, "id", "label").collect()} == expected


def test_cut_values_join_without_broadcast(spark, skewed, monkeypatch):
    from langweave import scratch

    expected = {r["id"]: r["split"] for r in sampling.stratified_split(skewed, "id", "label").collect()}
    monkeypatch.setattr(scratch.small_side, "__defaults__", (0,))
    assert {r["id"]: r["split"] for r in sampling.stratified_split(skewed, "id", "label").collect()} == expected


@pytest.mark.parametrize("n", [0, 1, 17, 2999, 3000, 5000])
def test_sample_exact(spark, skewed, n):
    got = {r["id"] for r in sampling.sample_exact(skewed, n, "id").collect()}
    assert got == set(order(range(3000))[:n])


def test_tiny_groups(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id long, label string")
    out = {r["id"]: r["split"] for r in sampling.stratified_split(df, "id", "label").collect()}
    first = order([2, 3])[0]
    assert out[1] == "test" and out[first] == "train" and len(out) == 3


def test_ids_are_contiguous_and_ordered(spark, skewed):
    out = {r["id"]: r["key"] for r in sampling.assign_ids(skewed.withColumnRenamed("id", "key"), "x", "key").collect()}
    assert out == {f"x_{i}": key for i, key in enumerate(order(range(3000)))}


def test_split_plan_leaves_rows_in_place(spark, skewed):
    split = sampling.stratified_split(skewed, "id", "label")
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_null_keys_are_an_error(spark):
    df = spark.createDataFrame([(1, "a"), (None, "a"), (3, "b")], "id long, label string")
    for build in (
        lambda: sampling.assign_ids(df.withColumnRenamed("id", "key"), "x", "key"),
        lambda: sampling.stratified_split(df, "id", "label"),
        lambda: sampling.sample_exact(df, 1, "id"),
    ):
        with pytest.raises(Exception, match="null key"):
            build().collect()


def test_repeated_keys_leave_no_exact_sample(spark):
    df = spark.createDataFrame([(7,), (7,), (7,)], "id long")
    with pytest.raises(ValueError, match="repeated"):
        sampling.sample_exact(df, 2, "id")
    assert sampling.sample_exact(df, 3, "id").count() == 3


def test_exact_rows_per_group(spark, skewed):
    sizes = {r["label"]: r["count"] for r in skewed.groupBy("label").count().collect()}
    ids = {label: order([r["id"] for r in skewed.filter(F.col("label") == label).collect()]) for label in sizes}
    least = min(sizes.values())
    got = sampling.exact_per_group(skewed, "id", "label", F.col("_least")).collect()
    for label in sizes:
        assert {r["id"] for r in got if r["label"] == label} == set(ids[label][:least])
    empty = sampling.exact_per_group(skewed.limit(0), "id", "label", F.col("_least"))
    assert empty.count() == 0 and empty.columns == skewed.columns


def test_counting_passes_read_keys_only(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "cast(id % 3 as string) as label", "repeat('x', 50) as text")
    rows.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t")).withColumn("text", F.upper("text"))
    counted = sampling._prefix_counts(sampling._keyed(table, "id", F.col("label"), 42))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan


def test_quotas_of_very_many_labels(spark):
    """100 000 labels, one of them hot; nothing about single labels comes to the driver."""
    hot = spark.range(5000).select(F.col("id"), F.lit("hot").alias("label"))
    many = spark.range(5000, 205_000).select("id", F.concat(F.lit("l"), (F.col("id") % 100_000)).alias("label"))
    rows = hot.unionByName(many).unionByName(spark.range(-10, 0).select("id", F.lit(None).cast("string").alias("label")))
    least = sampling.exact_per_group(rows, "id", "label", F.col("_least"))
    counts = least.groupBy("label").count().groupBy("count").count().collect()
    assert [tuple(r) for r in counts] == [(2, 100_001)]
    assert {r["id"] for r in least.filter("label = 'hot'").collect()} == set(order(range(5000))[:2])
    share = sampling.exact_per_group(rows, "id", "label", F.ceil(F.col("_size") * 410 / F.col("_total")))
    assert share.filter("label = 'hot'").count() == 10 and share.count() == 100_010


def test_quotas_of_an_empty_table_and_of_null_labels(spark):
    empty = spark.createDataFrame([(1, None)], "id long, label string")
    assert sampling.exact_per_group(empty, "id", "label", F.col("_least")).count() == 0


def test_ids_of_several_sources_in_one_ranking(spark, monkeypatch):
    rows = spark.range(500).select(F.col("id").alias("key"), F.concat(F.lit("t"), "id").alias("text"), (F.col("id") % 3).cast("string").alias("of"))
    again = rows.filter("of = '1'").withColumn("of", F.lit("other"))
    both = rows.unionByName(again)
    expected = {}
    for of in ("0", "1", "2", "other"):
        keys = [k for k in range(500) if str(k % 3) == of or (of == "other" and k % 3 == 1)]
        expected |= {f"{of}_{i}": f"t{k}" for i, k in enumerate(order(keys))}
    out = sampling.assign_ids(both, F.col("of"), "key")
    assert out.columns == ["key", "text", "of", "id"] and {r["id"]: r["text"] for r in out.collect()} == expected
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    # The same without a broadcast, and with ranges of few rows.
    from langweave import scratch

    monkeypatch.setattr(scratch.small_side, "__defaults__", (0,))
    monkeypatch.setattr(sampling, "RANGE_ROWS", 7)
    assert {r["id"]: r["text"] for r in sampling.assign_ids(both, F.col("of"), "key").collect()} == expected


def test_ranking_reads_no_texts_and_repeated_keys_are_an_error(spark, tmp_path):
    spark.range(50).selectExpr("id as key", "repeat('x', 50) as text").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t")).withColumn("text", F.upper("text"))
    places = sampling.seeded_positions(table, "key", F.lit("s"))
    assert "text" not in places._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="repeated"):
        sampling.assign_ids(table.unionByName(table), "x", "key")
    assert sampling.assign_ids(table.limit(0), "x", "key").count() == 0
