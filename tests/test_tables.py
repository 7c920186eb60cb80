import json

import pytest
from pyspark.sql import functions as F

from langweave.fixed_values import REJECT_MESSAGE, SYSTEM_PROMPTS
from langweave.operators import cleaning, lookups, metrics, turns, weak_labels
from langweave.operators.sampling import sample_exact
from langweave.plans import corpus as corpus_plan
from langweave.sources import corpora


def test_requests_with_faults(spark):
    bodies = ['{"text":"salam"}', '{"text":"  "}', "{}", '{"text":null}', "not json", '{"text":5}', "[1]", '{"text":" a b "}', None]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    accepted, rejected = turns.validate_requests(df)
    assert {r["i"]: r["text"] for r in accepted.collect()} == {0: "salam", 7: "a b"}
    out = rejected.collect()
    assert {r["i"] for r in out} == {1, 2, 3, 4, 5, 6, 8}
    assert {(r["status"], r["error"]) for r in out} == {(400, REJECT_MESSAGE)}


def test_generation_round_trip(spark):
    df = spark.createDataFrame(
        [(1, " salam ", "AR_DAR", "arabizi"), (2, "x", "FR", None), (3, "y", "MIX", None)], "id int, text string, label string, script string"
    )
    requests, unknown = turns.build_generation_requests(df, "id")
    rows = {r["id"]: r for r in requests.collect()}
    assert [tuple(m) for m in rows[1]["messages"]] == [("system", SYSTEM_PROMPTS["AR_DAR_LAT"]), ("user", "salam")]
    assert (rows[2]["prompt_key"], rows[2]["temperature"], rows[2]["max_tokens"]) == ("FR", 0.4, 512)
    assert [r["id"] for r in unknown.collect()] == [3]
    results = spark.createDataFrame(
        [(1, json.dumps({"choices": [{"message": {"content": "\n ok "}}, {"message": {"content": "no"}}]})), (2, '{"choices":[]}')], "id int, body string"
    )
    assert {r["id"]: r["answer"] for r in turns.parse_generation_results(results, "id").collect()} == {1: "ok", 2: None}


def test_response_keeps_null_script(spark):
    detections = spark.createDataFrame(
        [(1, "FR", 0.9, {"FR": 0.9}, None, "d", 1.5, "FR")],
        "id int, label string, confidence double, scores map<string,double>, script string, detector_name string, detect_ms double, prompt_key string",
    )
    generations = spark.createDataFrame([(1, "oui", "g", 2.0)], "id int, answer string, generator_name string, generate_ms double")
    body = json.loads(turns.emit_responses(turns.assemble_turns(detections, generations, "id")[0], "id").first()["body"])
    assert body == {
        "answer": "oui", "label": "FR", "scores": {"FR": 0.9}, "confidence": 0.9, "timings": {"detect_ms": 1.5, "generate_ms": 2.0},
        "model": {"detector": "d", "generator": "g"}, "script": None, "prompt_key": "FR",
    }


def test_csv_round_trip_and_missing_file(spark, tmp_path):
    rows = [("1", ' lead "q", \\ comma,\nnew line  ', "L"), ("2", None, "L"), ("3", "ما", None)]
    df = spark.createDataFrame(rows, "id string, text string, label string")
    corpora.write_csv(df, str(tmp_path / "csv"))
    back = corpora.scan_csv_optional(spark, str(tmp_path / "csv"), df.columns)
    assert sorted(map(tuple, back.collect())) == rows
    assert corpora.scan_csv_optional(spark, str(tmp_path / "none"), df.columns).count() == 0


def test_project_source_renames_what_is_there(spark):
    a = spark.createDataFrame([("t", "fr", 1)], "text string, labels string, other int")
    b = spark.createDataFrame([("t", "L")], "text_raw string, label_original string")
    assert tuple(corpora.project_source(a, "s").first()) == ("t", "fr", "s")
    assert tuple(corpora.project_source(b, "s").first()) == ("t", "L", "s")
    assert tuple(corpora.project_source(a, "s", "AR_DAR").first()) == ("t", "AR_DAR", "s")


def test_corpus_plan(spark):
    dialect = spark.createDataFrame([(i, f"wach nta {i}") for i in range(40)], "k long, text string")
    langid = spark.createDataFrame([(1, "bonjour toi", "FR"), (2, None, "FR"), (3, "http://only.url", "EN"), (4, "1 2", "EN")], "k long, text string, labels string")
    msa = spark.createDataFrame([(1, "مرحبا", "AR_MSA")], "k long, text string, label string")
    unified = corpus_plan.unify(dialect, langid, msa, "k")
    assert unified.count() == 40 + 3 + 1
    assert {r["id"] for r in unified.filter("source = 'Atlaset'").collect()} == {f"atlaset_{i}" for i in range(40)}
    funnel = cleaning.row_funnel(unified).first()
    assert tuple(funnel) == (44, 43, 42)
    split = corpus_plan.clean_and_split(unified)
    assert split.count() == 42 and set(split.columns) == {"id", "text_raw", "label_original", "source", "text_norm", "split"}
    counts = {r["source"]: r["n_rows"] for r in cleaning.source_counts(split).collect()}
    assert counts == {"Atlaset": 40, "papluca": 1, "NADI2022": 1}
    counted = {r["source"]: r["n_rows"] for r in corpus_plan.usable_counts(dialect, langid, msa, "k").collect()}
    assert counted == counts
    # Only a sample that is asked for cuts anything.
    sampled = corpus_plan.unify(sample_exact(dialect, 10, "k"), langid, msa, "k")
    assert sampled.count() == 10 + 3 + 1


def test_metrics_with_absent_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "y string, p string")
    rows = {r["label"]: r for r in metrics.classification_report(df).collect()}
    assert rows["a"]["f1"] == pytest.approx(0.5) and rows["c"]["precision"] == 0.0 and rows["c"]["support"] == 1
    assert rows["accuracy"]["f1"] == 0.5 and rows["macro avg"]["f1"] == pytest.approx((0.5 + 2 / 3 + 0) / 3)
    assert metrics.macro_f1(df).first()[0] == rows["macro avg"]["f1"]
    matrix = [tuple(r) for r in metrics.confusion_matrix(df, ["c", "b", "a"]).collect()]
    assert matrix == [("a", 1, 1, 0), ("b", 0, 1, 0), ("c", 1, 0, 0)]
    assert metrics.error_rows(df, "y", "p").count() == 2


def test_labels(spark):
    df = spark.createDataFrame([("FR",), ("EN",), (None,), ("FR",)], "label_original string")
    coded = sorted((r["label_original"] or "", r["label_id"]) for r in lookups.label_encode(df).collect())
    assert coded == [("", None), ("EN", 0), ("FR", 1), ("FR", 1)]
    shown = [tuple(r) for r in lookups.label_display(df.select(F.col("label_original").alias("label"))).orderBy("label").collect()]
    assert shown[0] == (None, None, False) and shown[1] == ("EN", "Anglais", False)
    weights = {r["label_original"]: r["weight"] for r in metrics.class_weights(df).collect()}
    assert weights == {"FR": 0.75, "EN": 1.5}


def test_sink_splits_prunes(spark, tmp_path):
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 5, "train").otherwise("test"))
    stored = corpora.sink_splits(df, str(tmp_path / "s"))
    plan = stored.filter("split = 'train'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and stored.filter("split = 'train'").count() == 5


def test_turns_without_an_answer_fail_aloud(spark):
    detections = spark.createDataFrame(
        [(k, "FR", 0.9, {"FR": 0.9}, None, "d", 1.5, "FR") for k in (1, 2, 3)],
        "id int, label string, confidence double, scores map<string,double>, script string, detector_name string, detect_ms double, prompt_key string",
    )
    generations = spark.createDataFrame(
        [(1, "oui", "g", 2.0), (2, None, "g", 2.0)], "id int, answer string, generator_name string, generate_ms double"
    )
    answered, failed = turns.assemble_turns(detections, generations, "id")
    assert [r["id"] for r in answered.collect()] == [1]
    assert sorted((r["id"], r["status"]) for r in failed.collect()) == [(2, 500), (3, 500)]


def test_missing_predictions_are_wrong(spark):
    df = spark.createDataFrame([("a", "a"), ("a", None), ("b", "b"), ("b", "a")], "y string, p string")
    assert metrics.accuracy(df).first()["accuracy"] == 0.5
    scores = {r["label"]: (r["recall"], r["support"]) for r in metrics.class_scores(df).collect()}
    assert scores == {"a": (0.5, 2), "b": (0.5, 2)}


def test_a_body_that_names_its_text_twice_is_rejected(spark):
    df = spark.createDataFrame([(1, '{"text":"a","text":"b"}'), (2, '{"text":"c"}')], "id int, body string")
    accepted, rejected = turns.validate_requests(df)
    assert [r["text"] for r in accepted.collect()] == ["c"] and [r["id"] for r in rejected.collect()] == [1]


def test_gold_labels_settle_conflicts(spark, tmp_path):
    rows = [
        ("1", "t", "FR"), ("1", "t", " FR "), ("2", "t", "FR"), ("2", "t", "EN"), ("3", "t", "EN"), ("3", "t", "FR"), ("3", "t", "EN"),
        ("4", "t", " "), ("4", "t", None), ("5", "t", ""), ("5", "t", "MIX"), (None, "t", "EN"), ("9", "t", "EN"),
    ]
    corpora.write_csv(spark.createDataFrame(rows, "id string, text_raw string, label string"), str(tmp_path / "gold"))
    docs = spark.createDataFrame([(i, f"text {i}") for i in (1, 2, 3, 4, 5, 6, None)], "doc_id long, text string")
    found = weak_labels.ingest_gold(docs.unionByName(docs.filter("doc_id = 1")), str(tmp_path / "gold"), "doc_id")
    assert sorted(map(tuple, found.collect())) == [(1, "text 1", "FR"), (1, "text 1", "FR"), (3, "text 3", "EN"), (5, "text 5", "MIX")]
    settled = weak_labels.settled_labels(spark.createDataFrame(rows, "id string, text_raw string, label string"))
    assert {tuple(r) for r in settled.filter("id in ('2', '3')").collect()} == {("2", None, 1, 1), ("3", "EN", 2, 1)}
    assert weak_labels.ingest_gold(docs, str(tmp_path / "none"), "doc_id").count() == 0
