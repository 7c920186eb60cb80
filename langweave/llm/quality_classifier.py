"""Quality classifier: support vectors over n-gram indicators scaled by naive Bayes log-count ratios.

A document is the set of its hashed word 1- and 2-grams and a few facts on their form. Each indicator is scaled by the
log ratio of its smoothed counts in good and bad training documents and by the length of the document's vector; a
linear hinge-loss model with the rarer class weighted up is fitted to these by dual coordinate descent, and its margins
are turned into probabilities by a logistic curve. Scoring is local to the row.

Only fitting sees a sample: at most ``max_train_rows`` labelled rows, those whose hashed ids come first (their
features, some hundred integers a row, are what the one fitting task holds). Every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from langweave.llm.batches import text_rows
from langweave.llm.columns import unclashed, whole, words
from langweave.llm.quality_rules import with_ngrams
from langweave.scratch import computed_once

BITS = 20
MAX_TRAIN_ROWS = 20_000
FOLDS = 5
EPOCHS = 8
COST = 1.0
SEED = 7
THRESHOLD = 0.3


def held_out(doc_id: str) -> Column:
    """Is the row kept out of training? One in five, by the checksum of its id as text; a null id is in training."""
    rest = F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))
    return F.coalesce(rest == 0, F.lit(False))


def indicators(docs: DataFrame, text: str = "text", bits: int = BITS) -> DataFrame:
    """Add ``_features``: the distinct feature numbers of a text, below ``2 ** bits``.

    Word 1- and 2-grams, the last two characters of words (which words never seen before share with known ones), and
    eighth by eighth the share reached by pairs that are one word twice.
    """
    docs = with_ngrams(computed_once(docs, "_words", words(whole(text))), text, F.col("_words"))
    endings = F.transform("_words", lambda w: F.xxhash64(F.lit("ending"), F.right(w, F.lit(2))))
    pairs = F.size("_grams2")
    twice = F.size(F.filter("_grams1", lambda g, i: F.get("_grams1", i + 1) == g))
    steps = F.ceil(8 * twice / F.greatest(pairs, F.lit(1))).cast("int")
    reached = F.transform(F.sequence(F.lit(0), steps), lambda k: F.xxhash64(F.lit("same word twice"), k))
    # A text without words has no indicators at all.
    extra = F.when(pairs > 0, reached).otherwise(F.slice(F.col("_grams1"), 1, 0))
    numbers = F.transform(
        F.concat("_grams1", "_grams2", endings, extra), lambda g: F.pmod(g, F.lit(1 << bits)).cast("int")
    )
    return docs.withColumn("_features", F.array_distinct(numbers)).drop("_words", "_grams1", "_grams2")


class Model:
    """Weights of the indicators, the offset, and the curve from margins to probabilities."""

    def __init__(self, weights: np.ndarray, offset: float, slope: float, shift: float):
        self.weights, self.offset, self.slope, self.shift = weights, offset, slope, shift

    def margin(self, features: np.ndarray) -> float:
        if not len(features):
            return self.offset
        return float(self.weights[features].sum() / np.sqrt(len(features)) + self.offset)

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features) + self.shift, -40, 40))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    good, bad = np.ones(size), np.ones(size)
    for features, label in zip(rows, labels):
        (good if label else bad)[features] += 1
    return np.log(good / good.sum()) - np.log(bad / bad.sum())


def dual_coordinate_descent(
    rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, epochs: int = EPOCHS, cost: float = COST
) -> tuple[np.ndarray, float]:
    """Hinge loss, L2 penalty: one dual variable a row, each moved to its optimum in turn, in seeded order.

    The offset is the weight of one more indicator that every row has. Classes weigh alike in total.
    """
    signs = np.where(labels, 1.0, -1.0)
    share = max(labels.mean(), 1 / len(labels)) if labels.any() else 1.0
    limit = np.where(labels, cost * 0.5 / share, cost * 0.5 / max(1 - share, 1 / len(labels)))
    values = [scale[r] / np.sqrt(max(len(r), 1)) for r in rows]
    curvature = np.array([v @ v + 1.0 for v in values])
    weights, offset, dual = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    order, random = np.arange(len(rows)), np.random.default_rng(SEED)
    for _ in range(epochs):
        random.shuffle(order)
        for i in order:
            slope = signs[i] * (weights[rows[i]] @ values[i] + offset) - 1
            moved = min(max(dual[i] - slope / curvature[i], 0.0), limit[i])
            step = (moved - dual[i]) * signs[i]
            if step:
                weights[rows[i]] += step * values[i]
                offset += step
                dual[i] = moved
    return weights, offset


def logistic_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability of label 1 by Newton's method, towards smoothed targets."""
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    theta, design = np.array([1.0, 0.0]), np.column_stack([margins, np.ones(len(margins))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -40, 40)))
        gradient = design.T @ (p - target) + 1e-3 * theta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, size: int) -> Model:
    """The classifier of the given rows; without rows, or with one label only, the score is that label's share."""
    if not len(labels) or labels.all() or not labels.any():
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(size, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    scale = log_count_ratios(rows, labels, size)
    # Each half is scored by a model of the other half, so that the curve is not fitted to margins the model has seen.
    halves, margins = np.arange(len(rows)) % 2, np.zeros(len(rows))
    for half in (0, 1):
        seen = np.flatnonzero(halves != half)
        if not labels[seen].any() or labels[seen].all():
            continue
        part = [rows[i] for i in seen]
        ratio = log_count_ratios(part, labels[seen], size)
        weights, offset = dual_coordinate_descent(part, labels[seen], ratio)
        other = Model(weights * ratio, offset, 1.0, 0.0)
        for i in np.flatnonzero(halves == half):
            margins[i] = other.margin(rows[i])
    weights, offset = dual_coordinate_descent(rows, labels, scale)
    return Model((weights * scale).astype(np.float32), offset, *logistic_curve(margins, labels))


def train(
    docs: DataFrame, labels: DataFrame, text: str = "text", bits: int = BITS, max_train_rows: int = MAX_TRAIN_ROWS
) -> Model:
    """Fit on labelled rows outside the held-out fold; the sample's ids are broadcast (8 bytes each).

    Each id gives one row: of rows that repeat an id, that with the least features counts, and of an id's labels the
    smaller. Null ids and null labels are not learned from, a null text has no features, and columns beside id and text
    are not read. Without labelled rows the model scores every document alike.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("_label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_rows)
    texts = docs.select("doc_id", whole(text).alias("text"))
    rows = indicators(texts.join(F.broadcast(sample), "doc_id"), "text", bits)
    rows = rows.groupBy("doc_id").agg(F.min("_features").alias("_features"), F.min("_label").alias("_label"))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, features, marks = [], [], []
        for batch in batches:
            ids += batch.column("doc_id").to_pylist()
            features += [np.array(f.values, np.int32) for f in batch.column("_features")]
            marks += batch.column("_label").to_pylist()
        # Rows arrive in any order; the descent's order must not depend on it.
        order = sorted(range(len(ids)), key=lambda i: (ids[i], len(features[i])))
        model = fit([features[i] for i in order], np.array([marks[i] == 1 for i in order], bool), 1 << bits)
        yield pa.record_batch(
            [
                pa.array([model.weights.astype("<f4").tobytes()], pa.binary()),
                pa.array([[model.offset, model.slope, model.shift]], pa.list_(pa.float64())),
            ],
            names=["weights", "numbers"],
        )

    gathered = text_rows(rows.select("doc_id", "_features", "_label")).repartition(1)
    found = gathered.mapInArrow(fitted, "weights binary, numbers array<double>").first()
    if found is None:  # no labelled row at all
        return fit([], np.array([], bool), 1 << bits)
    return Model(np.frombuffer(bytes(found["weights"]), "<f4"), *found["numbers"])


def score_documents(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", bits: int = BITS) -> DataFrame:
    """``doc_id, score`` (0 to 1, higher: label 1 is likelier) of every row.

    A null or empty text has no indicators and gets the score of the offset alone. Null ids pass through, repeated rows
    are scored alike, other columns are not read. Empty tables give an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = indicators(docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text")), "text", bits)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            scores = [known.score(f.values.to_numpy()) for f in batch.column("_features")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    fields = [rows.schema["doc_id"], StructField("score", DoubleType())]
    return text_rows(rows.select("doc_id", "_features")).mapInArrow(score, StructType(fields))


def classify(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted``: 1 where the score reaches the threshold."""
    return unclashed(scores, "held_out", "predicted").select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
