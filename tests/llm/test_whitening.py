"""Embedding whitening against plain numpy, and the refinement on spectra of every kind."""

import math

import numpy as np
import pytest
from odd_rows import DATA

from repoquarry.llm import whitening as w


def spectrum(kind, d):
    if kind == "spread":
        return np.geomspace(1, 1e-4, d)
    close = {"close": 1e-9 * np.arange(d // 2), "equal": np.zeros(d // 2)}[kind]
    return np.concatenate([1 + close, np.linspace(0.1, 0.5, d - d // 2)])


@pytest.mark.parametrize("kind", ["spread", "close", "equal"])
@pytest.mark.parametrize("d", [2, 9, 64])
def test_eigenpairs_in_double_precision(kind, d):
    turn = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))[0]
    matrix = (turn * spectrum(kind, d)) @ turn.T * 1e5
    matrix = (matrix + matrix.T) / 2
    values, vectors = w.eigenpairs(matrix)
    assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 4e-15
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-15 * 1e5 * math.sqrt(d)
    assert (np.diff(values) <= 0).all()
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1], rtol=1e-12, atol=1e-9)


def test_refinement_corrects_single_precision():
    x = np.random.default_rng(0).standard_normal((100, 20)) * np.arange(1, 21)
    matrix = x.T @ x
    exact = np.linalg.eigh(matrix)[1]
    start = np.linalg.eigh(matrix.astype(np.float32))[1].astype(np.longdouble)
    error = []
    for _ in range(3):
        start, _ = w.refined(matrix.astype(np.longdouble), start)
        error.append(float(np.abs(np.abs((start * exact).sum(axis=0)) - 1).max()))
    assert error[-1] < 1e-14


def test_sliced_products():
    draw = np.random.default_rng(2)
    a = draw.standard_normal((30, 40)).astype(np.longdouble) * 1e-7
    b = draw.standard_normal((40, 20)).astype(np.longdouble) + 1e-12
    a[3] = 0
    exact = a @ b
    assert np.abs(w.product(a, b) - exact).max() < 1e-18 * np.abs(a).max() * np.abs(b).max() * 40


def test_matrices_without_variance():
    values, vectors = w.eigenpairs(np.zeros((3, 3)))
    assert (values == 0).all() and (vectors == np.eye(3)).all()
    assert w.eigenpairs(np.array([[4.0]]))[0].tolist() == [4.0]


def brute(vectors):
    x = np.floor(1024 * np.array(vectors, dtype=float)).astype(np.int64) + 100000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    covariance = centred.T @ centred / n
    values, components = np.linalg.eigh(covariance)
    values, components = values[::-1][:8], components[:, ::-1][:, :8]
    return ((n * x - sums) ** 2).sum(axis=1), centred @ components / np.sqrt(values), values / np.trace(covariance)


def compare(rows, found):
    deviation, whitened, explained = brute([v for _, v in rows])
    at = {i: k for k, (i, _) in enumerate(rows)}
    grid = np.zeros_like(whitened)
    for r in found:
        grid[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == len(rows) and r.deviation == deviation[at[r.vec_id]]
        assert math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-9) and 0 <= r.identity_error < 1e-9
    assert len(found) == whitened.size
    signs = np.sign((grid * whitened).sum(axis=0))
    assert np.abs(grid * signs - whitened).max() < 1e-8


def test_embeddings_against_numpy(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    compare(rows, w.whiten(table).collect())
    # Whole numbers add up to the same sums in any order, so the layout changes no component.
    found = [w.fit_whitening(table.repartition(n))[64] for n in (7, 2)]
    assert found[0].sums == found[1].sums and (found[0].vectors == found[1].vectors).all()


def test_odd_vectors(spark):
    draw = np.random.default_rng(5)
    good = [(i, [float(c) for c in draw.standard_normal(3)]) for i in range(20)]
    good += [(100 + i, good[0][1]) for i in range(10)]
    bad = [(40, None), (41, []), (42, [1.0, None, 2.0]), (43, [math.nan, 0.0, 0.0]), (44, [1.0, math.inf, 0.0]), (45, [1e300, 0.0, 0.0])]
    pairs = [(60, [1.0, 2.0]), (61, [3.0, 5.0]), (None, [0.5, 0.25])]
    rows = [(i, v, "x", 7) for i, v in good + bad + pairs]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string, n int").repartition(3)
    found = w.whiten(df).collect()
    assert {r.vec_id for r in found} == {i for i, _ in good} | {60, 61, None}
    compare(good, [r for r in found if r.n == len(good)])
    assert len([r for r in found if r.n == 3]) == 6
    # Without variance there is nothing to divide by.
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "vec_id long, embedding array<double>")
    assert {(r.whitened, r.explained, r.identity_error, r.deviation) for r in w.whiten(same).collect()} == {(None, None, None, 0)}
    line = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(4)], "vec_id long, embedding array<double>")
    assert [r.whitened is None for r in w.whiten(line).orderBy("component").collect()] == [False] * 4 + [True] * 4
    assert w.whiten(df.where("false")).count() == 0
    assert w.whiten(df.where("embedding IS NULL")).count() == 0


def test_sums_beyond_a_long(spark):
    rows = [(i, [float(i % 2 * 2**51), 1.0]) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = w.whiten(df).collect()
    assert len(found) == 12 and {r.deviation for r in found} == {None}
    assert {abs(round(r.whitened, 9)) for r in found if r.component == 1} == {1.0}
