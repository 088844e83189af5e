"""Whitened embeddings against plain numpy and exact fractions."""

from fractions import Fraction

import numpy as np
import pytest

from podium.llm import queries, whitening
from tests.llm.conftest import SF_DIR

VECTORS = "vec_id long, embedding array<float>, label int"


def by_hand(vectors):
    """(whole numbers, deviations, eigenvalues, eigenvectors) in one process."""
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    off = n * x - sums
    y = off / n
    values, found = np.linalg.eigh(y.T @ y / n)
    return x, (off * off).sum(axis=1), values[::-1], found[:, ::-1]


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").orderBy("vec_id").collect()
    x, deviation, values, vectors = by_hand([r.embedding for r in table])
    n = len(table)
    rows = queries.queries()["op12_whitening"](spark, SF_DIR).collect()
    assert len(rows) == n * 32
    got = np.zeros((n, 32))
    place = {r.vec_id: i for i, r in enumerate(table)}
    for r in rows:
        i = place[r.vec_id]
        got[i, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[i] and r.identity_error < 1e-10
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-10)
    want = (x - x.mean(axis=0)) @ vectors[:, :32] / np.sqrt(values[:32])
    want *= np.sign((want * got).sum(axis=0))
    assert np.abs(got - want).max() < 1e-9
    assert np.abs(got.T @ got / n - np.eye(32)).max() < 1e-10


def _spectra():
    rand = np.random.default_rng(3)
    yield np.linspace(1, 2, 40)
    yield 10.0 ** -np.arange(12)
    yield np.array([1.0, 1.0, 1.0, 2.0, 2.0, 5.0])  # repeated
    yield np.array([1.0, 1 + 1e-13, 3.0])  # a close pair
    yield np.r_[np.zeros(20), 1.0]  # singular
    yield np.array([1e12, 1.0, 1e-3])
    yield -np.arange(5.0)
    yield rand.standard_normal(70) ** 8
    yield np.zeros(4)
    yield np.array([7.0])


@pytest.mark.parametrize("spectrum", list(_spectra()))
def test_division_of_symmetric_matrices(spectrum):
    size = len(spectrum)
    turn, _ = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    matrix = turn * spectrum @ turn.T
    matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.divided(matrix)
    scale = max(np.abs(spectrum).max(), 1e-300)
    assert np.all(np.diff(values) <= 1e-13 * scale)
    assert np.abs(values - np.sort(spectrum)[::-1]).max() <= 1e-13 * scale * size
    assert np.abs(vectors.T @ vectors - np.eye(size)).max() <= 1e-12
    assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-13 * scale * size


def test_polar_factor():
    rand = np.random.default_rng(1)
    matrix = rand.standard_normal((30, 30))
    matrix = matrix + matrix.T
    values, vectors = np.linalg.eigh(matrix)
    assert np.abs(whitening.polar(matrix) - vectors * np.sign(values) @ vectors.T).max() < 1e-12


def _found(spark, rows, schema=VECTORS):
    return whitening.whitened(spark.createDataFrame(rows, schema)).collect()


def test_odd_rows(spark):
    good = [(i, [float(i % 7), float(i * i % 11), 1.0], 0) for i in range(40)]
    odd = [
        (100, None, 0), (101, [1.0, None, 2.0], 0), (102, [1.0, float("nan"), 2.0], 0),
        (103, [float("inf"), 0.0, 0.0], 0), (104, [], 0), (105, [1.0], 0), (106, [1.0] * 4, 0),
        (107, [1.0] * 4, 0), (108, [1e30, 0.0, 0.0], 0),
    ]
    twice = [(None, [3.0, 4.0, 1.0], 0), (5, good[5][1], 0)]
    rows = _found(spark, good + odd + twice)
    # The third dimension never varies.
    assert {r.component for r in rows} == {1, 2} and len(rows) == 2 * 42
    x, deviation, values, vectors = by_hand([v for _, v, _ in good + twice])
    assert sorted({r.deviation for r in rows}) == sorted(set(deviation.tolist()))
    assert max(r.identity_error for r in rows) < 1e-10
    same = {(r.component, r.whitened) for r in rows if r.vec_id == 5}
    assert len(same) == 2 and sum(r.vec_id is None for r in rows) == 2


def test_no_variance_and_no_vectors(spark):
    assert _found(spark, [(1, [1.0, 2.0], 0)]) == []
    assert _found(spark, [(i, [1.0, 2.0], 0) for i in range(5)]) == []
    assert _found(spark, [(1, None, 0)]) == []
    empty = whitening.whitened(spark.createDataFrame([], VECTORS))
    assert empty.collect() == []
    assert empty.dtypes == whitening.whitened(
        spark.createDataFrame([(1, [1.0], 0), (2, [2.0], 0)], VECTORS)
    ).dtypes


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(2**40 * (i % 3)), float(i), float(-(2**30) * (i % 5))], 0) for i in range(60)]
    clash = "vec_id long, embedding array<double>, whitened int"
    every = _found(spark, rows, clash)
    assert len({(r.vec_id, r.component) for r in every}) == len(every) and max(r.component for r in every) <= 3
    found = {r.vec_id: r for r in every}
    x = [[int(64 * c) + 1_000_000 for c in v] for _, v, _ in rows]
    sums = [sum(c) for c in zip(*x)]
    for i, row in enumerate(x):
        exact = sum((60 * a - s) ** 2 for a, s in zip(row, sums))
        assert found[i].deviation == (exact if exact < 2**63 else None)


def test_covariance_is_rounded_once(spark):
    rows = [(i, [i / 7, (i * 37 % 101) / 3], 0) for i in range(101)]
    model = whitening.fit(spark.createDataFrame(rows, VECTORS).repartition(7))
    x = by_hand([v for _, v, _ in rows])[0].tolist()
    n = len(x)
    sums = [sum(c) for c in zip(*x)]
    var = [Fraction(sum((n * r[d] - sums[d]) ** 2 for r in x), n**3) for d in range(2)]
    assert model.trace == pytest.approx(float(sum(var)), rel=1e-15)
