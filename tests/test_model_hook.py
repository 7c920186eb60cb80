import os
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from langweave.operators.model_hook import score_with

SCHEMA = "n long, twice array<double>"


def loader(folder, close_marks=False):
    """Every load leaves a file, and so does every close."""

    def load():
        (folder / f"load-{uuid.uuid4().hex}").touch()

        class Model:
            def __call__(self, batch):
                (folder / f"call-{uuid.uuid4().hex}-{batch.num_rows}-{batch.nbytes}").touch()
                texts = batch.column("text").to_pylist()
                return {"twice": [[2.0 * len(t)] if t is not None else None for t in texts], "n": [len(t or "") for t in texts]}

            def close(self):
                (folder / f"close-{uuid.uuid4().hex}").touch()

        return Model()

    return load


def marks(folder, kind):
    return [name for name in os.listdir(folder) if name.startswith(kind)]


def test_loads_once_per_partition_with_rows(spark, tmp_path):
    rows = spark.range(100).select("id", F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text")).repartition(4)
    rows = rows.unionByName(rows.limit(0))
    wanted = sum(1 for n in rows.rdd.glom().map(len).collect() if n)
    found = score_with(rows, loader(tmp_path), ["text"], SCHEMA, ["id"], batch_rows=7).collect()
    assert {(r["id"], r["n"], r["twice"][0]) for r in found} == {(i, i, 2.0 * i) for i in range(100)} and len(found) == 100
    assert len(marks(tmp_path, "load")) == wanted == len(marks(tmp_path, "close"))
    assert max(int(name.split("-")[2]) for name in marks(tmp_path, "call")) == 7


def test_batches_are_bounded_in_bytes(spark, tmp_path):
    rows = spark.range(40).select("id", F.repeat(F.lit("y"), 1000).alias("text")).coalesce(1)
    long = spark.createDataFrame([(99, "z" * 50_000)], "id long, text string")
    found = score_with(rows.unionByName(long), loader(tmp_path), ["text"], SCHEMA, ["id"], batch_bytes=10_000)
    assert found.agg(F.sum("n")).first()[0] == 90_000
    sizes = [tuple(map(int, name.split("-")[2:])) for name in marks(tmp_path, "call")]
    assert all(size <= 10_000 or n == 1 for n, size in sizes) and max(size for _, size in sizes) > 50_000


def test_nulls_empty_tables_and_types(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, ""), (2, "")], "id long, text string")
    found = score_with(rows, loader(tmp_path), ["text"], SCHEMA, ["id", "text"])
    assert sorted(map(tuple, found.collect()), key=str) == [(1, None, 0, None), (2, "", 0, [0.0]), (2, "", 0, [0.0])]
    assert found.dtypes == [("id", "bigint"), ("text", "string"), ("n", "bigint"), ("twice", "array<double>")]
    assert score_with(rows.limit(0), loader(tmp_path / "x"), ["text"], SCHEMA, ["id"]).count() == 0


@pytest.mark.parametrize(
    ("model", "message"),
    [
        (lambda b: {"n": [1] * b.num_rows}, "no column"),
        (lambda b: {"n": [1], "twice": [None]}, "1 values of 'n' for 2 rows"),
        (lambda b: {"n": ["one"] * b.num_rows, "twice": [None] * b.num_rows}, "'n' is no int64"),
    ],
)
def test_a_model_against_its_declaration(spark, model, message):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string").coalesce(1)
    with pytest.raises(Exception, match=message):
        score_with(rows, lambda: model, ["text"], SCHEMA, ["id"]).collect()


def test_record_batches_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a")], "id long, text string")
    model = lambda b: pa.RecordBatch.from_pydict({"extra": [0], "size": pa.array([1], pa.int8())})
    assert score_with(rows, lambda: model, ["text"], "size long", ["id"]).collect() == [(1, 1)]
    with pytest.raises(ValueError, match="both kept and declared"):
        score_with(rows, lambda: model, ["text"], "ID long", ["id"])
