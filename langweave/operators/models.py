"""Fitting, choosing, storing and applying language classifiers with ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from langweave.fixed_values import DETECTOR_NAME, SVM_C, SVM_MAX_ITER
from langweave.functions import scores as sc
from langweave.functions.text import NormalizeOptions, is_arabizi, normalize_text, script_of_dialect
from langweave.operators import grams, linear_fit
from langweave.operators.features import FeatureModel, literal_array
from langweave.operators.metrics import macro_f1
from langweave.scratch import computed_once, in_small_batches, small_side
from langweave.sources.corpora import path_exists
from langweave.sources.versions import current_version, publish

SVM, SOFTMAX = "svm", "softmax"
# No class's objective may lie above its minimum by more than this share.
SVM_TOLERANCE = 1e-3


@dataclass(frozen=True)
class LinearPart:
    """Coefficients by slot and the intercept of one class."""

    coefficients: list[float]
    intercept: float


@dataclass
class LanguageClassifier:
    """Features, one fitted classifier and its labels in index order.

    ``parts`` holds a ``LinearPart`` per label, or a single fitted model of ``pyspark.ml`` for the softmax.
    """

    kind: str
    features: FeatureModel
    parts: list
    labels: list[str]

    def _weights(self) -> list[tuple[list[float], float]]:
        """Coefficients and intercept per class."""
        if isinstance(self.parts[0], LinearPart):
            return [(part.coefficients, part.intercept) for part in self.parts]
        fitted = self.parts[0]
        return list(zip(fitted.coefficientMatrix.toArray().tolist(), fitted.interceptVector.toArray().tolist()))

    def matrix(self) -> np.ndarray:
        """Classes by slots, with the intercept as last slot."""
        return np.array([[*coefficients, intercept] for coefficients, intercept in self._weights()])

    def add_scores(self, df: DataFrame, slots: str = "slots", weights: str = "weights") -> DataFrame:
        """Add ``scores`` by class from the vector entries of a row: SVM margins, softmax probabilities.

        All classes are linear in the entries, so a row is scored where it is, in a table or a stream.
        """
        margins = []
        for coefficients, intercept in self._weights():
            by_slot = literal_array(coefficients)
            products = F.zip_with(slots, weights, lambda i, x: x * F.get(by_slot, i))
            margins.append(F.aggregate(products, F.lit(float(intercept)), lambda total, x: total + x))
        return self.add_scores_of(df, F.array(*margins))

    def add_scores_of(self, df: DataFrame, margins: Column, name: str = "scores") -> DataFrame:
        """Add the scores that belong to the classes' margins."""
        if self.kind == SVM:
            return computed_once(df, name, margins)
        scored = computed_once(df, "_margins", margins)
        return computed_once(scored, name, sc.softmax(F.col("_margins"))).drop("_margins")

    def score_vectors(self, vectors: DataFrame) -> DataFrame:
        """``scores`` and ``pred`` for a table with assembled ``features``."""
        scored = self.add_scores_of(in_small_batches(vectors), vector_scores(F.col("features"), self.matrix()))
        return scored.withColumn("pred", self.top_label())

    def predict(self, df: DataFrame, text: str) -> DataFrame:
        """Add ``scores`` and ``pred`` to rows with normalised text; no shuffle, no state.

        All inside the row, by native expressions; ``predict_table`` is several times faster over a table.
        """
        scored = self.add_scores(self.features.add_entries(df, text))
        return scored.withColumn("pred", self.top_label()).drop("slots", "weights")

    def predict_table(self, df: DataFrame, text: str) -> DataFrame:
        """As ``predict``, in Arrow batches."""
        scored = self.add_scores_of(in_small_batches(df), self.features.text_scores(F.col(text), self.matrix()))
        return scored.withColumn("pred", self.top_label())

    def top_label(self) -> Column:
        return sc.label_at(sc.argmax(F.col("scores")), self.labels)

    def save(self, spark: SparkSession, path: str) -> None:
        self.features.save(spark, f"{path}/features")
        if isinstance(self.parts[0], LinearPart):
            save_parts(spark, self.parts, f"{path}/linear")
        else:
            self.parts[0].write().overwrite().save(f"{path}/part_0")
        rows = [(self.kind, i, label) for i, label in enumerate(self.labels)]
        stored = spark.createDataFrame(rows, "kind string, label_id int, label string")
        stored.coalesce(1).write.parquet(f"{path}/labels")


def vector_scores(vectors: Column, matrix: np.ndarray) -> Column:
    """Scores of assembled vectors by the rows of ``matrix``, in Arrow batches."""

    def score(indices: pa.Array, values: pa.Array) -> pa.Array:
        lengths = pc.list_value_length(indices).fill_null(0).to_numpy().astype(np.int64)
        found = linear_fit.scores(matrix, indices.flatten().to_numpy(), values.flatten().to_numpy(), lengths)
        return grams.scores_array(found)

    entries = F.unwrap_udt(vectors)
    return F.arrow_udf(score, "array<double>")(entries["indices"], entries["values"])


def save_parts(spark: SparkSession, parts: Sequence[LinearPart], path: str) -> None:
    """A row per class; a folder that is there already is replaced."""
    rows = [(i, part.coefficients, float(part.intercept)) for i, part in enumerate(parts)]
    stored = spark.createDataFrame(rows, "label_id int, coefficients array<double>, intercept double")
    stored.coalesce(1).write.mode("overwrite").parquet(path)


def load_parts(spark: SparkSession, path: str) -> list[LinearPart]:
    rows = spark.read.parquet(path).orderBy("label_id").collect()
    return [LinearPart(list(r["coefficients"]), r["intercept"]) for r in rows]


def parts_of(weights: np.ndarray) -> list[LinearPart]:
    """The rows of a weight matrix whose last slot is the intercept."""
    return [LinearPart(row[:-1].tolist(), float(row[-1])) for row in weights]


def weights_of(parts: Sequence[LinearPart]) -> np.ndarray:
    return np.array([[*part.coefficients, part.intercept] for part in parts])


def save_model(spark: SparkSession, model: LanguageClassifier, path: str) -> str:
    """Store ``model`` under ``path`` in place of the one before, and return its version's folder.

    Readers find the old or the new model, never parts of both: see ``publish``.
    """
    return publish(spark, path, lambda folder: model.save(spark, folder))


def load_model(spark: SparkSession, path: str) -> LanguageClassifier:
    """The model last saved under ``path``."""
    path = current_version(spark, path)
    rows = spark.read.parquet(f"{path}/labels").orderBy("label_id").collect()
    kind, labels = rows[0]["kind"], [row["label"] for row in rows]
    features = FeatureModel.load(spark, f"{path}/features")
    if path_exists(spark, f"{path}/linear"):
        parts = load_parts(spark, f"{path}/linear")
    else:
        parts = [LogisticRegressionModel.load(f"{path}/part_0")]
    return LanguageClassifier(kind, features, parts, labels)


def class_counts(df: DataFrame, label: str) -> dict[str, int]:
    """Rows per class, by sorted label: as many rows as the classifier has classes."""
    rows = df.groupBy(label).count().orderBy(label).collect()
    return {row[label]: row["count"] for row in rows}


def _with_label_id(vectors: DataFrame, label: str, labels: Sequence[str]) -> DataFrame:
    position = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label))
    return vectors.withColumn("_label_id", (position - 1).cast("double"))


def _svm_loss(vectors: DataFrame, label: str, c: float) -> tuple[list[str], linear_fit.Loss]:
    """The classes, and the loss that weighs the positives of each by ``n / (k * n_c)``."""
    counts = class_counts(vectors, label)
    n = sum(counts.values())
    return list(counts), linear_fit.Loss(linear_fit.HINGE, tuple(n / (len(counts) * k) for k in counts.values()), n, c)


def train_linear_svm(
    vectors: DataFrame,
    label: str,
    features: FeatureModel,
    c: float = SVM_C,
    max_iter: int = SVM_MAX_ITER,
    tol: float = SVM_TOLERANCE,
) -> LanguageClassifier:
    """One linear SVM per class against the rest: squared hinge, positives weighted ``n / (k * n_c)``.

    All classes are fitted together, a pass over ``vectors`` at a time, until each objective is proven to lie within a
    share of ``tol`` of its minimum, or ``max_iter`` passes are over; ``svm_certificate`` tells which.
    """
    labels, loss = _svm_loss(vectors, label, c)
    rows = linear_fit.with_class_ids(vectors, label, labels)
    with linear_fit.kept_blocks(rows) as blocks:
        fit = linear_fit.fit_margins(blocks, loss, len(labels), features.size, max_iter, tol)
    return LanguageClassifier(SVM, features, parts_of(fit.weights), labels)


def svm_certificate(model: LanguageClassifier, vectors: DataFrame, label: str, c: float = SVM_C) -> DataFrame:
    """``label, objective, gradient, excess``: how far each class of a fitted SVM may be from its optimum.

    One aggregation over the vectors gives objective and gradient of all classes at the model's weights. The objective is
    curved by one or more in every direction, so it lies above its minimum by at most half the squared gradient;
    ``excess`` is that as a share of the objective.
    """
    labels, loss = _svm_loss(vectors, label, c)
    if labels != model.labels:
        raise ValueError(f"the vectors have classes {labels}, the model {model.labels}")
    fit = linear_fit.start(
        linear_fit.with_class_ids(vectors, label, labels), loss, len(labels), model.features.size, weights_of(model.parts)
    ).run(1, 0.0)
    lengths = np.sqrt((fit.gradient**2).sum(axis=1))
    rows = [(x, float(v), float(g), float(e)) for x, v, g, e in zip(labels, fit.value, lengths, fit.bound())]
    return vectors.sparkSession.createDataFrame(rows, "label string, objective double, gradient double, excess double")


def train_softmax(
    vectors: DataFrame, label: str, features: FeatureModel, reg_param: float = 1e-4, max_iter: int = 100
) -> LanguageClassifier:
    """Multinomial logistic regression: the classifier that emits class probabilities."""
    labels = list(class_counts(vectors, label))
    rows = _with_label_id(vectors, label, labels).select("features", "_label_id")
    fit = LogisticRegression(
        featuresCol="features", labelCol="_label_id", family="multinomial", regParam=reg_param, maxIter=max_iter
    ).fit(rows)
    return LanguageClassifier(SOFTMAX, features, [fit], labels)


def compare_models(
    models: Mapping[str, LanguageClassifier],
    phrases: DataFrame,
    key: str,
    text: str,
    expected: str,
    options: NormalizeOptions = NormalizeOptions(),
) -> DataFrame:
    """``model, key, expected, pred, confidence, ok``: each model over the same labelled raw texts.

    The models may be built on different features. Texts are read and normalised once, and all models score the row in the
    same pass, in Arrow batches; those of one set of features share its entries. Confidence is the top probability; an
    SVM has none.
    """
    rows = computed_once(
        phrases.select(key, F.col(expected).alias("expected"), text), "_norm", normalize_text(F.col(text), options)
    )
    alike: dict[int, list[str]] = {}
    for name, model in models.items():
        alike.setdefault(id(model.features), []).append(name)
    scores, places = [], {}
    for names in alike.values():
        matrices = [models[name].matrix() for name in names]
        scores.append(models[names[0]].features.text_scores(F.col("_norm"), np.concatenate(matrices)))
        ends = np.cumsum([len(m) for m in matrices]).tolist()
        places |= {n: (len(scores) - 1, end - len(m), len(m)) for n, m, end in zip(names, matrices, ends)}
    rows = computed_once(in_small_batches(rows), "_found", F.array(*scores))
    margins = {n: F.slice(F.col("_found")[i], first + 1, classes) for n, (i, first, classes) in places.items()}
    return score_all(models, rows, margins).select(
        "model", key, "expected", "pred", "confidence", F.col("pred").eqNullSafe(F.col("expected")).alias("ok")
    )


def score_all(models: Mapping[str, LanguageClassifier], rows: DataFrame, margins: Mapping[str, Column]) -> DataFrame:
    """``rows`` once per model, with ``model``, ``pred`` and ``confidence``, from each model's ``margins`` in the row.
    Confidence is the top probability; an SVM has none."""
    given, records = rows.columns, []
    for i, (name, model) in enumerate(models.items()):
        rows = model.add_scores_of(rows, margins[name], f"_scores{i}")
        top = sc.label_at(sc.argmax(F.col(f"_scores{i}")), model.labels)
        confidence = F.array_max(f"_scores{i}") if model.kind == SOFTMAX else F.lit(None).cast("double")
        records.append(F.struct(F.lit(name).alias("model"), top.alias("pred"), confidence.alias("confidence")))
    return rows.select(*given, F.inline(F.array(*records)))


def select_best_model(
    candidates: Mapping[str, LanguageClassifier], valid_vectors: DataFrame, label: str
) -> tuple[str, DataFrame]:
    """Name of the candidate with the highest macro-F1 on the validation vectors, and all values.

    All candidates score a row in one pass and are judged by one grouped aggregation; ties go to the first name.
    """
    matrices = {name: model.matrix() for name, model in candidates.items()}
    margins, first = {}, 0
    for name, matrix in matrices.items():
        margins[name] = F.slice("_found", first + 1, len(matrix))
        first += len(matrix)
    found = vector_scores(F.col("features"), np.concatenate(list(matrices.values())))
    rows = computed_once(in_small_batches(valid_vectors.select(label, "features")), "_found", found).drop("features")
    scored = score_all(candidates, rows, margins).select("model", F.col(label).alias("y"), F.col("pred").alias("p"))
    values = macro_f1(scored, by=["model"])
    best = values.orderBy(F.desc("macro_f1"), "model").first()["model"]
    return best, values.withColumn("best", F.col("model") == best)


def score_linear(features: DataFrame, weights: DataFrame, intercepts: Mapping[str, float], key: str) -> DataFrame:
    """``key, scores, label, score``: given per-class weights over long ``key, feature, value`` rows.

    ``weights`` is ``feature, label, weight``; ``intercepts`` fixes the class order. The weights of all
    classes meet a feature row in one join, so the rows do not multiply by the classes, and features
    without a weight add nothing but keep their document. The first class wins ties.
    """
    labels = list(intercepts)
    by_class = [F.coalesce(F.sum(F.when(F.col("label") == x, F.col("weight"))), F.lit(0.0)) for x in labels]
    wide = weights.groupBy("feature").agg(*[w.alias(f"_w{i}") for i, w in enumerate(by_class)])
    parts = [F.coalesce(F.sum(F.col("value") * F.col(f"_w{i}")), F.lit(0.0)) for i in range(len(labels))]
    scores = F.array(*[part + float(intercepts[x]) for part, x in zip(parts, labels)])
    scored = features.join(small_side(wide), "feature", "left").groupBy(key).agg(scores.alias("scores"))
    top = sc.label_at(sc.argmax(F.col("scores")), labels)
    return scored.select(key, "scores", top.alias("label"), F.array_max("scores").alias("score"))


def detection(probabilities: Column, arabizi: Column, labels: Sequence[str]) -> Column:
    """The detection record of a probability array and the arabizi flag of the raw text."""
    label = sc.label_at(sc.argmax(probabilities), labels)
    return F.struct(
        label.alias("label"),
        F.round(F.array_max(probabilities), 4).alias("confidence"),
        sc.score_map(probabilities, labels).alias("scores"),
        script_of_dialect(label, arabizi).alias("script"),
        F.lit(DETECTOR_NAME).alias("detector_name"),
    )


def detect(model: LanguageClassifier, docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and the detection record of every raw text."""
    if model.kind != SOFTMAX:
        raise ValueError("detection needs class probabilities")
    raw = docs.select(key, text, is_arabizi(F.col(text)).alias("_arabizi"))
    rows = computed_once(raw, "_norm", normalize_text(F.col(text)))
    scored = (model.predict if docs.isStreaming else model.predict_table)(rows, "_norm")
    return scored.select(key, detection(F.col("scores"), F.col("_arabizi"), model.labels).alias("d")).select(key, "d.*")
