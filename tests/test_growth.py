"""What keeps the work of a query in step with its input."""

import glob

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from langweave import scratch
from langweave.functions import text as tx
from langweave.operators import features, grams, linear_fit, weak_labels
from langweave.sources import corpora

ODD = ["", " ", "\t  ", " a", "a ", "a b", "  ab\ncd  3l واش mixو \U0001f44d x", "​q", None]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_csv_files_hold_a_bounded_number_of_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpora, "CSV_ROWS", 10, raising=False)
    rows = spark.range(35).select(F.col("id").cast("string").alias("id"), F.lit('a "b"\nc').alias("text")).coalesce(1)
    corpora.write_csv(rows, f"{tmp_path}/csv")
    assert len(glob.glob(f"{tmp_path}/csv/part-*")) == 4
    again = corpora.scan_csv_optional(spark, f"{tmp_path}/csv", ["id", "text"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))


def test_tokens_are_counted_without_building_them(spark):
    rows = spark.createDataFrame([(x,) for x in ODD], "t string")
    text = F.col("t")
    got = rows.select("t", tx.count_tokens(text).alias("n"), F.size(tx.tokenize_ws(text)).alias("m")).collect()
    assert all(r["n"] == (None if r["t"] is None else len(r["t"].split())) and (r["t"] is None or r["n"] == r["m"]) for r in got)
    rows = rows.select(F.col("t").alias("text_raw"), F.col("t").alias("text_norm"), F.lit("EN").alias("label_original"))
    assert "lambda" not in plan(weak_labels.silver_labels(rows))


def test_costly_columns_are_computed_below_the_generator(spark):
    rows = scratch.computed_once(spark.createDataFrame([("a",)], "t string"), "x", F.md5("t"))
    generator = next(line for line in plan(rows).splitlines() if "Generate" in line)
    assert "md5" not in generator and rows.columns == ["t", "x"]
    assert rows.first()["x"] == "0cc175b9c0f1b6a831c399e269772661"


TEXTS = ["ab ab cd", " x  \U0001f44d\U0001f3fdé ퟿ ab", "", None, "cab", "ab cd ab cd ab", "\x00 a\x00b", "واش 3likom"]


@pytest.mark.parametrize("block", [features.WORD, features.CHAR])
@pytest.mark.parametrize("step", [1, 1 << 21])
def test_numbered_grams_are_those_of_the_patterns(spark, monkeypatch, block, step):
    """Counts of all grams in whole arrays equal those of the native patterns, and no row is made for a gram."""
    monkeypatch.setattr(grams, "STEP_BYTES", step)
    docs = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    options = features.FeatureOptions()
    every = np.ones(1 << 10, bool)
    found = features._counted_in(docs, "t", block, options, every)
    wanted = features.term_statistics(docs, "t", block, options)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    # The sketch counts every gram, and a term's bucket is the same wherever it stands.
    sketch = {r["bucket"]: r["n"] for r in features.term_sketch(docs, "t", block, options).collect()}
    assert sum(sketch.values()) == wanted.agg(F.sum("total_tf")).first()[0]
    vocabulary = features.fit_vocabulary(docs, "t", block, options)
    both = [f(docs, "t", block, vocabulary, options).drop("t").collect() for f in (features.add_tfidf, features.add_weighed)]
    for native, weighed in zip(*both):
        assert native[0] == weighed[0] and native[1] == pytest.approx(weighed[1])
    assert "regexp_extract_all" not in plan(features.add_weighed(docs, "t", features.CHAR, vocabulary, options))


def test_numbers_of_grams_are_dealt_anew_before_they_overflow(spark, monkeypatch):
    texts = pa.array(["abcd abce", "bcda"])
    few = pa.RecordBatch.from_arrays([texts], ["t"])
    full = np.ones(64, bool)
    wanted = [b.to_pydict() for b in grams.counted(False, (2, 4), full)([few])]
    monkeypatch.setattr(grams, "MOST", 20)
    assert [b.to_pydict() for b in grams.counted(False, (2, 4), full)([few])] == wanted


def test_a_fit_packs_its_vectors_once(spark):
    """Blocks give the sums of the rows they are made of, also of rows without entries, and are freed after the fit."""
    rows = spark.createDataFrame(
        [([0, 2], [1.0, 2.0], 0), ([], [], 1), ([1], [-1.0], 1), ([0, 1, 2], [0.5, 0.25, 1.0], 0)],
        "indices array<int>, values array<double>, y int",
    ).coalesce(1)
    loss = linear_fit.Loss(linear_fit.HINGE, (1.0, 2.0), 4)
    weights = np.arange(8.0).reshape(2, 4) / 10
    x = np.array([[1, 0, 2, 1], [0, 0, 0, 1], [0, -1, 0, 1], [0.5, 0.25, 1, 1]])
    parts, slopes = loss.of_rows(x @ weights.T, np.array([0, 1, 1, 0]))
    penalty, own = loss.penalty(weights.copy())
    for size in (1, 1 << 16):
        linear_fit.BLOCK_ENTRIES, kept = size, linear_fit.BLOCK_ENTRIES
        try:
            with linear_fit.kept_blocks(rows) as blocks:
                value, gradient = linear_fit.evaluate(blocks, weights, loss)
                assert blocks.storageLevel.useMemory and blocks.columns == ["slots", "entries", "lengths", "y"]
        finally:
            linear_fit.BLOCK_ENTRIES = kept
        assert not blocks.storageLevel.useMemory
        assert value == pytest.approx(parts + penalty) and gradient == pytest.approx(slopes.T @ x + own)


@pytest.mark.parametrize("clean", [True, False])
def test_an_svm_passes_over_the_rows_near_its_margins(spark, monkeypatch, clean):
    """With the same minimum; over all rows only to look at it. Where classes cannot be told apart, all rows are used."""
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 600)
    x = (4 * np.eye(6)[y] if clean else 0) + 0.5 * rng.standard_normal((600, 6))
    rows = spark.createDataFrame(
        [(list(range(6)), v.tolist(), int(k)) for v, k in zip(x, y)], "indices array<int>, values array<double>, y int"
    ).repartition(3)
    loss = linear_fit.Loss(linear_fit.HINGE, (2.0, 1.0, 1.5), 600)
    monkeypatch.setattr(linear_fit, "DRAWN_ROWS", 60)
    monkeypatch.setattr(linear_fit, "BLOCK_ENTRIES", 100)
    with linear_fit.kept_blocks(rows) as blocks:
        plain = linear_fit.start(blocks, loss, 3, 6).run(200, 1e-5)
        evaluate, whole = linear_fit.evaluate, []
        monkeypatch.setattr(linear_fit, "evaluate", lambda v, *a: whole.append(v is blocks) or evaluate(v, *a))
        fit = linear_fit.fit_margins(blocks, loss, 3, 6, 200, 1e-4)
        assert fit.passes == len(whole) and fit.bound().max() <= 1e-4
        assert fit.value == pytest.approx(plain.value, rel=2e-4)
        assert (sum(whole) * 3 < plain.passes) == clean and not all(whole)
        value, gradient = evaluate(blocks, fit.weights, loss)
        assert fit.value == pytest.approx(value) and fit.gradient == pytest.approx(gradient)
        for few in (2, 5):
            assert linear_fit.fit_margins(blocks, loss, 3, 6, few, 1e-9).passes == few


def test_working_rows_are_those_near_a_margin(spark):
    rows = spark.createDataFrame([([0], [2.0], 0), ([0], [0.5], 0), ([], [], 1), ([0], [-3.0], 1)],
                                 "indices array<int>, values array<double>, y int").coalesce(1)
    loss, weights = linear_fit.Loss(linear_fit.HINGE, (1.0, 1.0), 4), np.array([[1.0, 0.0], [-1.0, 0.0]])
    with linear_fit.kept_blocks(rows) as blocks:
        near = blocks.mapInArrow(linear_fit._near(weights, loss, 1.0), linear_fit._BLOCK_DDL).collect()
    assert [np.frombuffer(bytes(near[0][c]), t).tolist() for c, t in zip(("entries", "lengths", "y"), (float, int, int))] == [
        [0.5], [1, 0], [0, 1]
    ]


def test_batches_are_bounded_in_bytes(spark):
    """Rows alone bound no memory: a few hundred blocks of a fit are a few hundred megabytes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, "64m")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    rows = scratch.in_small_batches(spark.range(0, 40, 1, 1).select(F.expr("repeat('x', 1000000)").alias("t")))
    assert rows.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 10_000_000
    spark.conf.set(name, "1m")
    assert scratch.in_small_batches(rows) is rows and spark.conf.get(name) == "1m"
    spark.conf.set(name, "8m")


def test_sums_of_tasks_are_added_as_they_come():
    read = []

    def batches():
        for ranges in ([1, 1], [1, 2], [2], [], [3]):
            read.append(ranges)
            sums = [np.array([float(r), 1.0]).tobytes() for r in ranges]
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(sums, pa.binary())], ["range", "sums"])

    found = linear_fit._added(batches())
    first = next(found)
    assert len(read) == 2
    rows = [(b.column(0)[0].as_py(), np.frombuffer(b.column(1)[0].as_py()).tolist()) for b in (first, *found)]
    assert rows == [(1, [3.0, 3.0]), (2, [4.0, 2.0]), (3, [3.0, 1.0])]
    assert list(linear_fit._added([])) == []


def test_both_blocks_are_weighed_by_one_worker(spark):
    docs = spark.createDataFrame([("ab abc ab",), (None,)], "t string")
    entries = features.fit_features(docs.na.drop(), "t").add_entries(docs, "t", in_batches=True)
    assert entries._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
