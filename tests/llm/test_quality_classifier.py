import zlib

import numpy as np
import pytest

from langweave.llm.queries import op9_quality_classifier
from langweave.llm.quality_classifier import (
    Model,
    classify,
    dual_coordinate_descent,
    fit,
    held_out,
    log_count_ratios,
    score_documents,
    train,
)

BASE = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{BASE}/labels.parquet").collect()}
    got = op9_quality_classifier(spark, BASE).collect()
    assert len(got) == spark.read.parquet(f"{BASE}/documents.parquet").count()
    tested = [r for r in got if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert sum(r.predicted == labels[r.doc_id] for r in tested) >= 0.95 * len(tested)


def test_held_out_labels_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.withColumn("held", held_out("doc_id")).selectExpr("doc_id", "if(held, 1 - quality, quality) as quality")
    a, b = train(docs, labels), train(docs, turned)
    assert np.array_equal(a.weights, b.weights) and (a.offset, a.slope) == (b.offset, b.slope)


def test_descent_reaches_the_optimum():
    """No other weights have a lower hinge loss with penalty; checked from the dual gap."""
    random = np.random.default_rng(1)
    rows = [np.unique(random.integers(0, 30, 8)) for _ in range(80)]
    labels = np.array([3 in r or 7 in r for r in rows])
    scale = log_count_ratios(rows, labels, 30)
    weights, offset = dual_coordinate_descent(rows, labels, scale, epochs=400)
    signs, share = np.where(labels, 1, -1), labels.mean()
    cost = np.where(labels, 0.5 / share, 0.5 / (1 - share))

    def loss(w, b):
        margins = np.array([w[r] @ scale[r] / np.sqrt(len(r)) for r in rows]) + b
        return 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - signs * margins)).sum()

    best = loss(weights, offset)
    for _ in range(300):
        assert loss(weights + random.normal(0, 0.05, 30), offset + random.normal(0, 0.05)) >= best - 1e-6


def test_a_repeated_id_trains_once(spark, make):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    docs = [(k, f"{'good words here' if k % 2 else 'bad text there'} {k}") for k in range(40)]
    once, often = train(make(docs), labels), train(make(docs + [docs[3]] * 300 + [docs[4]] * 200), labels)
    assert np.array_equal(once.weights, often.weights) and once.offset == often.offset
    assert train(make([(k, None) for k in range(40)]), labels).score(np.array([], int)) >= 0


def test_one_label_or_none():
    some = [np.array([1, 2]), np.array([3])]
    assert fit([], np.array([], bool), 8).score(np.array([1])) == pytest.approx(0.5)
    assert fit(some, np.array([True, True]), 8).score(np.array([1])) > 0.5
    assert fit(some, np.array([False, False]), 8).score(np.array([], int)) < 0.5


def test_awkward_rows(awkward, spark):
    model = Model(np.ones(1 << 20, np.float32), -1.0, 1.0, 0.0)
    got = classify(score_documents(awkward.selectExpr("*", "1 as score"), model)).collect()
    assert len(got) == 10
    empty = {r.score for r in got if r.doc_id in (0, 1, 2)}
    assert len(empty) == 1 and empty.pop() == pytest.approx(1 / (1 + np.exp(1)))
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert score_documents(awkward.limit(0), model).collect() == []
    nothing = spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")
    assert train(awkward, nothing).score(np.array([5])) == pytest.approx(0.5)
