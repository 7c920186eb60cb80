"""Whitening of embeddings: principal components by contour integration (FEAST) of their exact covariance."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from langweave.scratch import materialize

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
# Entries beyond this have no exact long; half of long's range keeps differences exact, too.
LARGEST = float(2**61)
# Eigenvalues below this share of the trace are rounding, not variance.
LEAST_SHARE = 1e-12
QUADRATURE_POINTS = 16
MAX_ROUNDS = 200
BISECTIONS = 40
# Sums of integer products below this are exact in double precision.
EXACT = 2**53


# ---- eigenvalues in an interval ---------------------------------------------------------------


def count_below(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``matrix`` lie below ``shift``: the negative inertia of the difference.

    Symmetric elimination with pivots of one or two rows (Bunch and Parlett); by Sylvester's law the signs of the
    pivots are those of the eigenvalues.
    """
    a = np.array(matrix, dtype=float) - shift * np.eye(len(matrix))
    bound, below = (1 + 17**0.5) / 8, 0
    while len(a):
        diagonal = int(np.argmax(np.abs(np.diag(a))))
        off = np.abs(a - np.diag(np.diag(a)))
        r, s = np.unravel_index(int(np.argmax(off)), off.shape)
        one = abs(a[diagonal, diagonal]) >= bound * off[r, s]
        if one and a[diagonal, diagonal] == 0:
            return below
        front = [diagonal] if one else [int(r), int(s)]
        rest = [i for i in range(len(a)) if i not in front]
        pivot = a[np.ix_(front, front)]
        # A pivot of two rows has one eigenvalue of either sign.
        below += int(pivot[0, 0] < 0) if one else 1
        side = a[np.ix_(rest, front)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(pivot, side.T)
        a = (a + a.T) / 2
    return below


def contour_projection(matrix: np.ndarray, low: float, high: float, block: np.ndarray) -> np.ndarray:
    """``block`` projected onto the eigenvectors of ``matrix`` with eigenvalues between ``low`` and ``high``.

    The circle over the interval is integrated by Gauss-Legendre quadrature of its upper half; the lower half adds the
    complex conjugate. Each point is one solve with the shifted matrix.
    """
    points, weights = np.polynomial.legendre.leggauss(QUADRATURE_POINTS)
    centre, radius = (low + high) / 2, (high - low) / 2
    total = np.zeros_like(block)
    for x, weight in zip(points, weights):
        turn = np.exp(1j * np.pi / 2 * (1 - x))
        solved = np.linalg.solve((centre + radius * turn) * np.eye(len(matrix)) - matrix, block)
        total += weight / 2 * (radius * turn * solved).real
    return total


def eigenpairs_between(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues between ``low`` and ``high`` (falling) and their unit eigenvectors (columns).

    The projection of a block about twice as wide as ``count`` is repeated, Rayleigh-Ritz on it in between, until the
    residuals of the pairs inside are rounding errors. Raises if any is missed against ``count``.
    """
    size = len(matrix)
    if count == 0:
        return np.zeros(0), np.zeros((size, 0))
    width = min(size, 2 * count + 8)
    block = np.random.default_rng(size).standard_normal((size, width))
    scale, best = np.abs(matrix).sum(axis=1).max(), np.inf
    for _ in range(MAX_ROUNDS):
        basis = np.linalg.qr(contour_projection(matrix, low, high, block))[0]
        values, turns = np.linalg.eigh(basis.T @ matrix @ basis)
        vectors = basis @ turns
        inside = np.flatnonzero((values > low) & (values < high))
        residual = np.inf
        if len(inside) == count:
            residual = np.linalg.norm(matrix @ vectors[:, inside] - vectors[:, inside] * values[inside], axis=0).max()
        # Done when rounding is reached: the residual is tiny and no longer halves.
        if residual <= 1e-11 * scale and residual > best / 2:
            break
        best, block = min(best, residual), vectors
    if len(inside) != count or residual > 1e-11 * scale:
        raise ArithmeticError(f"{len(inside)} of {count} eigenvalues found, residual {residual:.3g}")
    inside = inside[::-1]
    return values[inside], vectors[:, inside]


def leading_eigenpairs(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a positive semidefinite matrix that are not rounding, falling, and vectors.

    Inertia counts bisect for an interval that holds just those and ends in the gap below them; where equal values
    straddle its end it holds all of them, and the first ``count`` are taken. Counts at both ends prove that the
    projection missed none.
    """
    size, trace = len(matrix), float(np.trace(matrix))
    if size == 0 or trace <= 0:
        return np.zeros(0), np.zeros((size, 0))
    matrix = matrix / trace

    def above(shift: float) -> int:
        return size - count_below(matrix, shift)

    def border(low: float, high: float, wanted: int) -> tuple[float, float]:
        """Narrow to where the count above a shift falls to ``wanted`` or less."""
        for _ in range(BISECTIONS):
            middle = (low + high) / 2
            low, high = (middle, high) if above(middle) > wanted else (low, middle)
        return low, high

    low, high = LEAST_SHARE, 2.0
    while high > LEAST_SHARE and not above(high / 2):
        high /= 2
    wanted = min(count, above(low))
    if not wanted:
        return np.zeros(0), np.zeros((size, 0))
    next_one, over_it = border(low, high, count) if above(low) > count else (low, low)
    last_one, _ = border(next_one, high, wanted - 1)
    gap = above(over_it) == wanted and last_one > over_it
    low = (over_it + last_one) / 2 if gap else next_one
    values, vectors = eigenpairs_between(matrix, low, high, above(low))
    return values[:count] * trace, vectors[:, :count]


# ---- the fit ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """``n`` fitted vectors, their sums, and the components: values, columns of vectors, share of the trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def middle(self) -> list[int]:
        """The whole part of the mean."""
        return [s // self.n for s in self.sums]

    @property
    def rest(self) -> np.ndarray:
        """The mean without its whole part, correctly rounded."""
        return np.array([float(Fraction(s % self.n, self.n)) for s in self.sums])

    def projected(self, centred: np.ndarray) -> np.ndarray:
        """Whitened vectors from integer ones less ``middle``."""
        return (centred - self.rest) @ self.vectors / np.sqrt(self.values)


def whole_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``rows`` whose vector is whole, with ``x`` = floor(64 * entry) + 1000000 as longs.

    Left out: a null vector, one with a null, non-finite or huge entry (its x would not fit a long exactly), and one
    whose length differs from the most frequent length (of equally frequent ones, the longest).
    """
    entries = F.col(vector).cast("array<double>")
    sound = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) < LARGEST))
    x = F.transform(entries, lambda c: F.floor(c * SCALE).cast("long") + OFFSET)
    kept = materialize(rows.filter(F.col(vector).isNotNull() & sound).withColumn("x", x), "whole-vectors")
    sizes = kept.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return kept.filter(F.size("x") == (sizes[0]["size"] if sizes else 0))


def _arrays(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    column = batch.column(name)
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The exact integer matrix product, in double precision where all sums fit it, else in Python's integers."""
    largest = int(np.abs(left).max(initial=0)) * int(np.abs(right).max(initial=0))
    if largest * len(right) < EXACT:
        return (left.astype(float) @ right.astype(float)).astype(np.int64).astype(object)
    return left.astype(object) @ right.astype(object)


def _summed(distinct: DataFrame, part: Callable[[np.ndarray], np.ndarray]) -> dict[tuple[int, int], int]:
    """Entries of the integer matrix ``part`` summed over all rows, exactly; a bounded number per task, added by key."""
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("v", pa.decimal128(38, 0))])

    def totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = part(_arrays(batch))
                total = found if total is None else total + found
        if total is not None:
            i, j = np.indices(total.shape)
            numbers = pa.array([int(v) for v in total.ravel()], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), numbers], schema=schema
            )

    parts = distinct.mapInArrow(totals, "i int, j int, v decimal(38,0)")
    return {(r["i"], r["j"]): int(r["v"]) for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct ``x`` of ``vectors``; None without any. Only matrices of the dimension come to the driver.

    Sums and products are integers, so the covariance is exact to its last bit and does not depend on how rows are
    dealt out: vectors are centred by the whole part of their mean, and what its rest adds is taken off exactly.
    """
    distinct = materialize(vectors.select("x").distinct(), "distinct-vectors")
    n = distinct.count()
    sums = _summed(distinct, lambda x: x.astype(object).sum(axis=0, keepdims=True))
    if not n or not sums:
        return None
    size = len(sums)
    whole = [sums[0, i] for i in range(size)]
    middle = np.array([s // n for s in whole], dtype=np.int64)

    def squares(x: np.ndarray) -> np.ndarray:
        return _product((x - middle).T, x - middle)

    products, rest = _summed(distinct, squares), [s % n for s in whole]
    covariance = np.array(
        [[float(Fraction(n * products[i, j] - rest[i] * rest[j], n * n)) for j in range(size)] for i in range(size)]
    )
    values, vectors_ = leading_eigenpairs(covariance, components)
    trace = float(np.trace(covariance))
    fitted = Whitening(n, tuple(whole), values, vectors_, values / trace if len(values) else values, 0.0)
    return Whitening(n, tuple(whole), values, vectors_, fitted.explained, _identity_error(distinct, fitted))


def _identity_error(distinct: DataFrame, fitted: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, from a pass over them."""
    count = len(fitted.values)
    if not count:
        return 0.0
    middle = np.array(fitted.middle, dtype=np.int64)

    def moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count + 1, count))
        for batch in batches:
            if batch.num_rows:
                white = fitted.projected(_arrays(batch) - middle)
                total += np.vstack([white.sum(axis=0), white.T @ white])
        i, j = np.indices(total.shape)
        columns = [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "v"])

    parts = distinct.mapInArrow(moments, "i int, j int, v double")
    found = np.zeros((count + 1, count))
    for row in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        found[row["i"], row["j"]] = row["v"] / fitted.n
    covariance = found[1:] - np.outer(found[0], found[0])
    return float(np.abs(covariance - np.eye(count)).max())


# ---- applying it ------------------------------------------------------------------------------


def _deviations(centred: np.ndarray, n: int, rest: np.ndarray) -> list[int | None]:
    """Sums of (n * x - S)^2, exactly; None where a long can't hold one."""
    largest = n * int(np.abs(centred).max(initial=0)) + n
    if largest**2 * max(1, centred.shape[1]) < 2**63:
        return [int(v) for v in ((centred * n - rest) ** 2).sum(axis=1)]
    exact = (centred.astype(object) * n - rest.astype(object)) ** 2
    return [int(v) if v < 2**63 else None for v in exact.sum(axis=1)]


def whiten(rows: DataFrame, fitted: Whitening | None, key: str = "vec_id") -> DataFrame:
    """``key, n, deviation, whitened`` of rows with ``x``: ``whitened`` is an array with an entry per component."""
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n long, deviation long, whitened array<double>"
    if fitted is None:
        return rows.limit(0).selectExpr(f"`{key}`", "0L as n", "0L as deviation", "array(0D) as whitened")
    middle = np.array(fitted.middle, dtype=np.int64)
    rest = np.array([s % fitted.n for s in fitted.sums], dtype=np.int64)

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            centred = _arrays(batch) - middle
            white = fitted.projected(centred)
            offsets = np.arange(len(white) + 1, dtype=np.int32) * white.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    pa.array(np.full(len(white), fitted.n, dtype=np.int64)),
                    pa.array(_deviations(centred, fitted.n, rest), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(white.ravel())),
                ],
                names=[key, "n", "deviation", "whitened"],
            )

    return rows.select(key, "x").mapInArrow(scored, schema)


def whitened_components(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each whole vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Fitted on the distinct integer vectors, applied to all rows; rows are left out as ``whole_vectors`` says, other
    columns are ignored, repeated ids and vectors keep a row each and a null id stays null. Components with less than
    10^-12 of the variance are left out, so equal vectors or a single one give no rows, as does an empty table.
    Components of equal eigenvalues are one choice among those that span the same space. ``deviation`` is null
    where a long can't hold it.
    """
    kept = whole_vectors(rows.select("vec_id", vector), vector)
    fitted = fit_whitening(kept, components)
    shares = [] if fitted is None else fitted.explained.tolist()
    explained: Column = F.array(*[F.lit(v) for v in shares]).cast("array<double>")
    long = whiten(kept, fitted).select("vec_id", "n", "deviation", F.posexplode("whitened").alias("_k", "whitened"))
    return long.select(
        "vec_id",
        (F.col("_k") + 1).alias("component"),
        "n",
        "deviation",
        "whitened",
        F.get(explained, F.col("_k")).alias("explained"),
        F.lit(0.0 if fitted is None else fitted.identity_error).alias("identity_error"),
    )
