import pytest

from langweave import scratch


def test_folder_comes_from_the_session(spark):
    assert scratch.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_local_session_without_the_setting_keeps_one_folder(spark, monkeypatch):
    monkeypatch.setattr(scratch, "CHECKPOINT_CONF", "spark.not.set")
    first = scratch.shared_folder(spark)
    assert first == scratch.shared_folder(spark) != spark.conf.get("spark.checkpoint.dir")
    monkeypatch.setattr(spark.sparkContext, "master", "yarn")
    with pytest.raises(ValueError):
        scratch.shared_folder(spark)


def test_small_side_is_broadcast_only_within_its_bound(spark):
    def plan(bound):
        joined = spark.range(100).join(scratch.small_side(spark.range(10), bound), "id")
        return joined._jdf.queryExecution().logical().toString()

    assert "strategy=broadcast" in plan(10) and "strategy=broadcast" not in plan(9)


def test_computed_once_survives_the_optimizer(spark):
    from pyspark.sql import functions as F

    df = scratch.computed_once(spark.range(3), "v", F.md5(F.col("id").cast("string")))
    plan = df.filter(F.length("v") > 0).select(F.concat("v", "v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5") == 1


def test_a_side_of_few_long_rows_is_not_broadcast(spark, monkeypatch):
    from pyspark.sql import functions as F

    from langweave import scratch

    rows = spark.range(20).select("id", F.repeat(F.lit("w"), 1000).alias("t"), F.array(F.lit("x")).alias("a"))
    left = spark.range(5)
    plan = lambda: left.join(scratch.small_side(rows), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan()
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", 10_000)
    assert "strategy=broadcast" not in plan()
    assert scratch.small_side(rows.limit(0)).count() == 0
