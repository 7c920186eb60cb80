import numpy as np
import pytest
from pyspark.sql import functions as F

from langweave.fixed_values import LABELS, ROBUSTNESS_PHRASES
from langweave.functions import scores as sc
from langweave.functions.text import normalize_text
from langweave.operators import features as ft
from langweave.operators import linear_fit, metrics, models, turns
from langweave.plans import training
from langweave.streaming import turns as streaming

WORDS = {
    "AR_DAR": ("wach", "nta", "labas", "3lik", "bghit", "nmchi", "واش", "بغيت"),
    "AR_MSA": ("العلم", "ما", "هي", "يجب", "علينا", "تطوير"),
    "EN": ("what", "are", "the", "best", "practices", "deep", "learning"),
    "FR": ("quels", "sont", "les", "avantages", "notre", "quotidien"),
}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = []
    for label, words in WORDS.items():
        for i in range(24 if label != "EN" else 48):
            text = " ".join(words[(i + j * j) % len(words)] for j in range(5))
            rows.append((f"{label}_{i}", label, text, "train" if i % 3 else "valid"))
    df = spark.createDataFrame(rows, "id string, label_original string, text_raw string, split string")
    return df.withColumn("text_norm", normalize_text(F.col("text_raw"))).cache()


@pytest.fixture(scope="module")
def tables(corpus):
    return training.prepare_training(corpus, ft.FeatureOptions(max_features=300))


@pytest.fixture(scope="module")
def svm(tables):
    return training.fit_svm(tables)


@pytest.fixture(scope="module")
def softmax(tables):
    return training.fit_softmax(tables, (1e-2, 1e-4))[0]


@pytest.mark.parametrize("kind", ["svm", "softmax"])
def test_separable_corpus(request, tables, kind):
    model = request.getfixturevalue(kind)
    score = metrics.macro_f1(training.predictions(model, tables.valid)).first()["macro_f1"]
    assert score >= 0.95 and model.labels == sorted(LABELS)


def test_row_scores_equal_ml_transform(softmax, svm, tables):
    mine = {r["id"]: r["scores"] for r in softmax.score_vectors(tables.valid).collect()}
    theirs = {r["id"]: r["probability"].toArray().tolist() for r in softmax.parts[0].transform(tables.valid).collect()}
    assert mine.keys() == theirs.keys()
    for key in mine:
        assert mine[key] == pytest.approx(theirs[key])
    margins = {r["id"]: r["scores"][2] for r in svm.score_vectors(tables.valid).collect()}
    part = svm.parts[2]
    raw = {r["id"]: r["features"].dot(part.coefficients) + part.intercept for r in tables.valid.collect()}
    assert margins == pytest.approx(raw)


def dense(tables, labels):
    rows = tables.train.collect()
    x = np.array([[*r["features"].toArray(), 1.0] for r in rows])
    return x, np.array([labels.index(r["label_original"]) for r in rows])


def test_svm_objective_gradient_and_bound(svm, tables):
    """Against a plain computation; the proven bound holds against a fit gone on with to rounding."""
    x, y = dense(tables, svm.labels)
    rows = {r["label"]: r for r in models.svm_certificate(svm, tables.train, training.LABEL).collect()}
    best = training.fit_svm(tables)
    tight = models.train_linear_svm(tables.train, training.LABEL, tables.features, tol=1e-10)
    for k, label in enumerate(svm.labels):
        sign = np.where(y == k, 1.0, -1.0)
        weight = np.where(y == k, len(y) / (len(svm.labels) * (y == k).sum()), 1.0)

        def at(model):
            w = np.array([*model.parts[k].coefficients, model.parts[k].intercept])
            short = np.maximum(0, 1 - sign * (x @ w))
            return (w @ w) / 2 + (weight * short**2).sum(), w - 2 * x.T @ (weight * sign * short)

        value, gradient = at(svm)
        assert rows[label]["objective"] == pytest.approx(value) and rows[label]["gradient"] == pytest.approx(np.linalg.norm(gradient))
        assert 0 <= (value - at(tight)[0]) / value <= rows[label]["excess"] <= models.SVM_TOLERANCE
        assert at(best)[0] == value


def test_an_unfinished_svm_has_no_certificate(tables):
    few = training.fit_svm(tables, max_iter=4)
    excess = [r["excess"] for r in models.svm_certificate(few, tables.train, training.LABEL).collect()]
    assert max(excess) > models.SVM_TOLERANCE


def test_softmax_gradient_equals_differences(tables):
    labels = sorted(LABELS)
    rows = linear_fit.with_class_ids(tables.train, training.LABEL, labels)
    loss = linear_fit.Loss(linear_fit.SOFTMAX_LOSS, (), tables.train.count(), reg=0.01)
    weights = np.random.default_rng(0).standard_normal((len(labels), tables.features.size + 1))
    _, gradient = linear_fit.evaluate(rows, weights, loss)
    for k, slot in ((0, 3), (2, tables.features.size), (3, 150)):
        values = []
        for sign in (1, -1):
            moved = weights.copy()
            moved[k, slot] += sign * 1e-5
            values.append(linear_fit.evaluate(rows, moved, loss)[0].sum())
        assert gradient[k, slot] == pytest.approx((values[0] - values[1]) / 2e-5, abs=1e-7)


def test_solver_reaches_the_optimum_of_pyspark(tables):
    reg, labels = 0.05, sorted(LABELS)
    rows = linear_fit.with_class_ids(tables.train, training.LABEL, labels)
    loss = linear_fit.Loss(linear_fit.SOFTMAX_LOSS, (), tables.train.count(), reg=reg)
    fit = linear_fit.start(rows, loss, len(labels), tables.features.size).run(300, 1e-9)
    scaled = models.LogisticRegression(
        featuresCol="features", labelCol="y", family="multinomial", regParam=reg, maxIter=500, tol=1e-12, standardization=False
    )
    theirs = scaled.fit(models._with_label_id(tables.train, training.LABEL, labels).withColumnRenamed("_label_id", "y"))
    found, wanted = fit.weights[:, :-1], theirs.coefficientMatrix.toArray()
    assert np.abs((found - found.mean(0)) - (wanted - wanted.mean(0))).max() < 1e-3


def test_best_step_is_kept_and_a_broken_fit_goes_on(tables, tmp_path, monkeypatch):
    """The valid rows get worse after the second step; a second run reads the stored steps."""
    given, calls, passes = iter([0.5, 0.9, 0.7, 0.9]), [], []
    real = training.macro_f1

    def judged(rows):
        assert real(rows).first()["macro_f1"] is not None
        score = next(given)
        calls.append(score)
        return rows.sparkSession.createDataFrame([(score,)], "macro_f1 double")

    monkeypatch.setattr(training, "macro_f1", judged)
    model, values = training.fit_in_steps(tables, str(tmp_path / "steps"), (1e-2, 1e-3), steps=2, passes=3)
    rows = {r["model"]: (r["macro_f1"], r["best"]) for r in values.collect()}
    assert rows == {
        "reg=0.01 step=1": (0.5, False), "reg=0.01 step=2": (0.9, True), "reg=0.001 step=1": (0.7, False), "reg=0.001 step=2": (0.9, False),
    }
    stored = models.load_parts(tables.train.sparkSession, str(tmp_path / "steps" / "1"))
    assert model.parts == stored and stored != models.load_parts(tables.train.sparkSession, str(tmp_path / "steps" / "3"))
    given = iter([0.1, 0.2, 0.3, 0.4])
    monkeypatch.setattr(linear_fit.Fit, "run", lambda self, *a: passes.append(a) or self)
    again, _ = training.fit_in_steps(tables, str(tmp_path / "steps"), (1e-2, 1e-3), steps=2, passes=3)
    assert not passes and again.parts == models.load_parts(tables.train.sparkSession, str(tmp_path / "steps" / "3"))


def test_a_warm_start_begins_lower(tables):
    labels = sorted(LABELS)
    rows = linear_fit.with_class_ids(tables.train, training.LABEL, labels)
    loose, tight = (linear_fit.Loss(linear_fit.SOFTMAX_LOSS, (), tables.train.count(), reg=r) for r in (1e-2, 1e-3))
    before = linear_fit.start(rows, loose, len(labels), tables.features.size).run(10, 1e-6)
    warm = linear_fit.start(rows, tight, len(labels), tables.features.size, before.weights).run(1, 0.0)
    cold = linear_fit.start(rows, tight, len(labels), tables.features.size).run(1, 0.0)
    assert warm.value.sum() < cold.value.sum()


@pytest.mark.parametrize("kind", ["svm", "softmax"])
def test_save_and_load(request, spark, tables, tmp_path, kind):
    model = request.getfixturevalue(kind)
    models.save_model(spark, model, str(tmp_path / kind))
    again = models.load_model(spark, str(tmp_path / kind))
    before = {r["id"]: (r["scores"], r["pred"]) for r in model.score_vectors(tables.valid).collect()}
    after = {r["id"]: (r["scores"], r["pred"]) for r in again.score_vectors(tables.valid).collect()}
    assert before == after


def test_saving_again_and_a_save_cut_off(spark, svm, softmax, tables, tmp_path, monkeypatch):
    path = str(tmp_path / "model")
    first = models.save_model(spark, svm, path)
    models.save_model(spark, softmax, path)
    assert models.load_model(spark, path).kind == models.SOFTMAX
    monkeypatch.setattr(models, "save_parts", lambda *a: (_ for _ in ()).throw(OSError("disk full")))
    with pytest.raises(OSError):
        models.save_model(spark, svm, path)
    monkeypatch.undo()
    assert models.load_model(spark, path).kind == models.SOFTMAX
    # A reader that had opened the first version still finds it.
    assert models.load_parts(spark, f"{first}/linear") == svm.parts
    with pytest.raises(FileNotFoundError):
        models.load_model(spark, str(tmp_path / "nothing"))


def test_models_of_different_features_score_in_one_pass(spark, corpus, tables, softmax):
    words = models.LanguageClassifier(models.SOFTMAX, tables.features.only(ft.WORD), softmax.parts, softmax.labels)
    tables_w = training.vector_tables(corpus, tables.features.only(ft.WORD))
    tables_c = training.vector_tables(corpus, tables.features.only(ft.CHAR))
    fitted = {"w": training.fit_svm(tables_w), "c": training.fit_softmax(tables_c)[0], "both": softmax}
    texts = corpus.select("id", "text_raw", "label_original").union(spark.createDataFrame([("n", None, "EN")], "a string, b string, c string"))
    compared = models.compare_models(fitted, texts, "id", "text_raw", "label_original")
    rows = {(r["model"], r["id"]): r["pred"] for r in compared.collect()}
    for name, model in fitted.items():
        alone = model.predict(corpus.select("id", "text_norm"), "text_norm")
        assert {r["id"]: r["pred"] for r in alone.collect()} == {i: p for (m, i), p in rows.items() if m == name and i != "n"}
    assert len(rows) == 3 * (corpus.count() + 1) and words.features.size < softmax.features.size
    plan = compared._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 0


def test_vectors_of_one_block_are_cut_from_those_of_both(corpus, tables, monkeypatch):
    wanted = {block: training.vector_tables(corpus, tables.features.only(block)) for block in (ft.WORD, ft.CHAR)}
    monkeypatch.setattr(ft, "script_ratios", lambda text: pytest.fail("a text is cut again"))
    for block, plain in wanted.items():
        cut = training.block_tables(tables, block)
        assert cut.features == plain.features
        for one, other in ((cut.train, plain.train), (cut.valid, plain.valid)):
            assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect())) and one.dtypes == other.dtypes


def test_tables_are_scored_in_batches_as_rows_are(spark, corpus, tables, svm, softmax):
    texts = corpus.select("id", "text_norm").union(spark.createDataFrame([("n", None), ("e", "")], "a string, b string"))
    words = models.LanguageClassifier(
        models.SVM, tables.features.only(ft.WORD), training.fit_svm(training.block_tables(tables, ft.WORD)).parts, svm.labels
    )
    for model in (svm, softmax, words):
        got, want = ({r["id"]: r for r in f(texts, "text_norm").collect()} for f in (model.predict_table, model.predict))
        assert got.keys() == want.keys() and len(got) == texts.count()
        for key, row in want.items():
            assert got[key]["scores"] == pytest.approx(row["scores"]) and got[key]["pred"] == row["pred"]


def test_detection_of_a_table_builds_no_string_for_a_gram(spark, corpus, softmax):
    found = models.detect(softmax, corpus.select("id", "text_raw"), "id", "text_raw")
    compared = models.compare_models({"a": softmax}, corpus, "id", "text_raw", "label_original")
    for rows in (found, compared):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        # Words are cut natively, grams of them are not.
        assert "(?<![^ ])" not in plan and "zip_with" not in plan and "Exchange" not in plan


def test_dialect_phrases_through_both_models(spark, svm, softmax):
    phrases = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(ROBUSTNESS_PHRASES)], "id int, phrase string, expected string")
    rows = models.compare_models({"svm": svm, "softmax": softmax}, phrases, "id", "phrase", "expected")
    result = {r["model"]: (r["n_correct"], r["n_total"]) for r in metrics.robustness_score(rows).collect()}
    assert set(result) == {"svm", "softmax"} and all(n == 10 for _, n in result.values())
    for row in rows.collect():
        assert row["ok"] == (row["pred"] == row["expected"])
        assert (row["confidence"] is None) == (row["model"] == "svm")


def test_detect_record(spark, softmax):
    docs = spark.createDataFrame([(1, "wach nta labas 3lik"), (2, "what are the best practices")], "id int, text string")
    rows = {r["id"]: r for r in models.detect(softmax, docs, "id", "text").collect()}
    assert rows[1]["label"] == "AR_DAR" and rows[1]["script"] == "arabizi"
    assert rows[2]["label"] == "EN" and rows[2]["script"] is None
    for row in rows.values():
        assert row["confidence"] == max(row["scores"].values()) and sum(row["scores"].values()) == pytest.approx(1, abs=3e-4)


def test_prediction_plan_has_no_shuffle(corpus, softmax):
    plan = softmax.predict(corpus.select("id", "text_norm"), "text_norm")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_stream_equals_batch(spark, softmax, tmp_path):
    rows = [(f"t{i}", body) for i, body in enumerate(['{"text":" wach nta labas 3lik "}', "not json", '{"text":"what are the best"}', "{}"])]
    requests = spark.createDataFrame(rows, "turn_id string, body string")
    source = str(tmp_path / "in")
    requests.repartition(2).write.parquet(source)
    score = streaming.classifier_scorer(softmax)

    def run():
        stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(source)
        paths = [str(tmp_path / p) for p in ("accepted", "rejected", "commits", "checkpoint")]
        streaming.stream_detect(stream, score, softmax.labels, *paths).awaitTermination()
        return [streaming.read_committed(spark, path, paths[2]).drop("run", "batch_id") for path in paths[:2]]

    run()
    requests.filter("turn_id = 't0'").withColumn("turn_id", F.lit("t9")).coalesce(1).write.mode("append").parquet(source)
    accepted, rejected = run()  # resumes from its checkpoint: only the new file is read
    batch, _ = turns.validate_requests(requests)
    expected = {tuple(r)[1:] for r in streaming.route_messages(batch, score, softmax.labels).select(
        "turn_id", "turn_id", "text_norm", "label", "confidence", "script", "prompt_key").collect()}
    got = {tuple(r) for r in accepted.select("turn_id", "text_norm", "label", "confidence", "script", "prompt_key").collect()}
    assert {g for g in got if g[0] != "t9"} == expected and len(got) == 3
    assert {r["turn_id"] for r in rejected.collect()} == {"t1", "t3"}


def test_a_fresh_checkpoint_overwrites_nothing(spark, softmax, tmp_path):
    score = streaming.classifier_scorer(softmax)
    for k in (1, 2):
        rows = spark.createDataFrame([(f"t{k}", '{"text":"what are the best"}')], "turn_id string, body string")
        rows.write.parquet(str(tmp_path / f"in{k}"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / f"in{k}"))
        paths = [str(tmp_path / p) for p in ("accepted", "rejected", "commits", f"checkpoint{k}")]
        streaming.stream_detect(stream, score, softmax.labels, *paths).awaitTermination()
    assert {r["turn_id"] for r in spark.read.parquet(str(tmp_path / "accepted")).collect()} == {"t1", "t2"}


@pytest.mark.parametrize("fails_at", ["rejected", "commits"])
def test_a_stop_between_the_sinks_shows_no_half_batch(spark, softmax, tmp_path, monkeypatch, fails_at):
    rows = spark.createDataFrame([("t1", '{"text":"what are the best"}'), ("t2", "{}")], "turn_id string, body string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    paths = [str(tmp_path / p) for p in ("accepted", "rejected", "commits", "checkpoint")]
    write = streaming._write

    def run():
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        streaming.stream_detect(stream, streaming.classifier_scorer(softmax), softmax.labels, *paths).awaitTermination()

    def stopping(frame, folder):
        if f"/{fails_at}/" in folder:
            raise OSError("the writer stops")
        write(frame, folder)

    monkeypatch.setattr(streaming, "_write", stopping)
    with pytest.raises(Exception, match="the writer stops"):
        run()
    # The accepted part is there, but no reader takes it for a batch.
    assert spark.read.parquet(paths[0]).count() == 1
    assert streaming.read_committed(spark, paths[0], paths[2]).count() == 0
    monkeypatch.setattr(streaming, "_write", write)
    run()
    run()
    found = [[r["turn_id"] for r in streaming.read_committed(spark, p, paths[2]).collect()] for p in paths[:2]]
    assert found == [["t1"], ["t2"]]
    log = spark.read.parquet(paths[2]).select("accepted", "rejected").collect()
    assert [tuple(r) for r in log] == [(1, 1)]


def test_a_batch_that_is_committed_is_not_written_again(spark, softmax, tmp_path, monkeypatch):
    """The query stops after the commit row and before its own checkpoint knows of the batch."""
    rows = spark.createDataFrame([("t1", '{"text":"what are the best"}')], "turn_id string, body string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    paths = [str(tmp_path / p) for p in ("accepted", "rejected", "commits", "checkpoint")]

    def run():
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        streaming.stream_detect(stream, streaming.classifier_scorer(softmax), softmax.labels, *paths).awaitTermination()

    run()
    for mark in (tmp_path / "checkpoint" / "commits").iterdir():
        mark.unlink()
    monkeypatch.setattr(streaming, "_write", lambda *a: pytest.fail("written twice"))
    run()
    assert streaming.read_committed(spark, paths[0], paths[2]).count() == 1


def test_fit_is_bounded_and_vocabulary_is_not(corpus):
    options = ft.FeatureOptions(max_features=300)
    bounded = training.prepare_training(corpus, options, max_train_rows=10)
    assert bounded.train.count() == 10
    assert bounded.features.word.terms == training.prepare_training(corpus, options).features.word.terms


def test_a_fit_sees_every_train_row(corpus, monkeypatch):
    """No number of rows is left out of the vectors unless a caller asks for a sample."""
    monkeypatch.setattr(training, "sample_exact", lambda rows, n, key: rows.limit(1))
    tables = training.prepare_training(corpus, ft.FeatureOptions(max_features=300))
    wanted = corpus.filter("split = 'train'").count()
    assert tables.train.count() == wanted
    assert training.vector_tables(corpus, tables.features.only(ft.WORD)).train.count() == wanted


def test_scorer_runs_on_a_plain_stream(spark, softmax, tmp_path):
    """Scoring keeps no state, so the same columns also work in an ordinary streaming plan."""
    rows = spark.createDataFrame([("a", "what are the best"), ("b", "quels sont les avantages")], "turn_id string, text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    routed = streaming.route_messages(stream, streaming.classifier_scorer(softmax), softmax.labels)
    query = (
        routed.select("turn_id", "label")
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", "EN"), ("b", "FR")}


def test_score_linear(spark):
    features = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "zz", 5.0)], "id int, feature string, value double")
    weights = spark.createDataFrame([("a", "X", 1.0), ("a", "Y", -1.0), ("b", "Y", 4.0)], "feature string, label string, weight double")
    rows = models.score_linear(features, weights, {"X": 0.0, "Y": 0.0}, "id").collect()
    assert {r["id"]: (r["label"], r["score"]) for r in rows} == {1: ("X", 2.0), 2: ("X", 0.0)}


def test_score_functions(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, 0.0],)], "z array<double>")
    row = df.select(
        sc.argmax(F.col("z")).alias("top"),
        sc.softmax(F.col("z")).alias("p"),
        sc.ranked_scores(F.col("z"), LABELS).alias("ranked"),
    ).first()
    assert row["top"] == 1 and sum(row["p"]) == pytest.approx(1)
    assert [tuple(e) for e in row["ranked"]] == [("AR_MSA", 3.0), ("EN", 3.0), ("AR_DAR", 1.0), ("FR", 0.0)]
