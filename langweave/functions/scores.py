"""Row-local functions over an array of class scores (index = class id)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(z: Column) -> Column:
    """Probabilities of a score array, shifted by its maximum."""
    top = F.array_max(z)
    parts = F.transform(z, lambda x: F.exp(x - top))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(parts, lambda x: x / total)


def argmax(z: Column) -> Column:
    """0-based position of the largest score, the lowest on ties."""
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def label_at(index: Column, labels: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(label) for label in labels]), (index + 1).cast("int"))


def score_map(probabilities: Column, labels: Sequence[str]) -> Column:
    """``label -> probability`` rounded to 4 decimals."""
    return F.map_from_arrays(
        F.array(*[F.lit(label) for label in labels]),
        F.transform(probabilities, lambda p: F.round(p, 4)),
    )


def ranked_scores(probabilities: Column, labels: Sequence[str]) -> Column:
    """Array of ``(label, score)`` by score descending, ties in class order; sorted inside the row."""
    entries = F.array(
        *[
            F.struct(
                (-probabilities[i]).alias("neg"),
                F.lit(i).alias("label_id"),
                F.lit(label).alias("label"),
            )
            for i, label in enumerate(labels)
        ]
    )
    return F.transform(
        F.sort_array(entries), lambda e: F.struct(e["label"].alias("label"), (-e["neg"]).alias("score"))
    )
