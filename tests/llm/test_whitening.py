import numpy as np
import pytest
from pyspark.sql import Row

from langweave.llm import queries
from langweave.llm.whitening import count_below, eigenpairs_between, leading_eigenpairs, whitened_components

DIR = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>"


def spectra():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 20, 64):
        base = rng.standard_normal((n, 2 * n))
        turn = np.linalg.qr(rng.standard_normal((n, n)))[0]
        equal = turn @ np.diag([5.0] * (n // 2) + [1.0] * (n - n // 2)) @ turn.T
        yield from (base @ base.T, base[:, : max(1, n // 6)] @ base[:, : max(1, n // 6)].T, (equal + equal.T) / 2)


def test_inertia_counts_eigenvalues():
    for matrix in spectra():
        values = np.linalg.eigvalsh(matrix)
        for shift in (-1.013, 0.5 * (values[0] + values[-1]) + 1e-3, values[-1] + 1):
            assert count_below(matrix, shift) == (values < shift).sum()
            assert count_below(matrix - 2 * np.eye(len(matrix)), shift) == (values - 2 < shift).sum()


def test_eigenpairs_to_rounding():
    for matrix in spectra():
        values, vectors = leading_eigenpairs(matrix, 16)
        wanted = np.linalg.eigvalsh(matrix)[::-1][:16]
        wanted = wanted[wanted > 1e-11 * np.trace(matrix)]
        assert len(values) == len(wanted)
        assert np.allclose(values, wanted, rtol=1e-12, atol=0)
        assert np.abs(matrix @ vectors - vectors * values).max() < 1e-13 * values[0] * len(matrix)
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


def test_a_wrong_count_is_noticed():
    with pytest.raises(ArithmeticError):
        eigenpairs_between(np.diag([1.0, 2.0, 3.0, 9.0]), 1.5, 4.0, 3)


def judge(rows, frame, components=16):
    """Hold the rows of the operator against numpy over the kept vectors of ``rows`` (id, list)."""
    x = np.array([np.floor(64 * np.array(v, dtype=np.float32).astype(float)) + 1_000_000 for _, v in rows]).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    got = frame.toPandas().sort_values(["vec_id", "component"])
    order = np.argsort([i for i, _ in rows], kind="stable")
    assert len(got) == len(rows) * len(values) and (got["n"] == n).all()
    deviations = ((n * x.astype(object) - sums) ** 2).sum(axis=1)[order]
    assert got["deviation"].tolist() == [int(d) for d in deviations for _ in values]
    assert np.allclose(got["explained"][: len(values)], values / (centred**2).sum() * n, rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    white = (x - fit.mean(axis=0)) @ vectors / np.sqrt(values)
    assert np.allclose(np.abs(got["whitened"].to_numpy().reshape(len(rows), -1)), np.abs(white[order]), atol=1e-7)


def test_query_equals_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()]
    judge(rows, queries.op13_whitening(spark, DIR))


def test_unusable_and_repeated_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(5).astype(np.float32).tolist()) for i in range(60)]
    same = [(100 + i, rows[0][1]) for i in range(30)]
    bad = [
        (200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("inf")] * 5),
        (204, []), (205, [1.0, 2.0]), (206, [3e38] * 5),
    ]
    frame = spark.createDataFrame([Row(vec_id=i, embedding=v) for i, v in rows + same + bad], VECTORS).repartition(4)
    judge(rows + same, whitened_components(frame.selectExpr("*", "1 as x", "2 as n", "'a' as whitened")))


def test_nothing_to_whiten(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], VECTORS)
    assert whitened_components(one).count() == 0
    assert whitened_components(one.limit(0)).count() == 0
    null_id = spark.createDataFrame([(None, [1.0, 2.0]), (2, [1.0, 3.0])], VECTORS)
    assert [(r.vec_id, r.component) for r in whitened_components(null_id).orderBy("vec_id").collect()] == [(None, 1), (2, 1)]


def test_exact_sums_beyond_double(spark):
    far = spark.createDataFrame([(1, [1e12]), (2, [-1e12]), (3, [0.0])], "vec_id long, embedding array<double>")
    got = whitened_components(far).orderBy("vec_id").collect()
    assert [r.deviation for r in got] == [None, None, 0]
    assert [round(abs(r.whitened), 12) for r in got] == [round(1.5**0.5, 12)] * 2 + [0.0]
