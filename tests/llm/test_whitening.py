"""Whitening against a dense eigendecomposition."""

import math
import os

import compare
import numpy as np
import pytest

from stopwise.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, x string, component int, n long"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "c", 1, 2) for i, v in vectors], SCHEMA).repartition(3)


def check(rows, vectors):
    """Result rows against numpy on the usable vectors."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in vectors], np.int64)
    n, dim = x.shape
    k = min(32, dim)
    off = n * x - x.sum(0)
    deviation = sorted((i, sum(int(a) ** 2 for a in row)) for (i, _), row in zip(vectors, off))
    assert sorted({(r["vec_id"], int(r["deviation"])) for r in rows}) == sorted(set(deviation))
    c = off / n
    v = c.T @ c / n
    values = np.sort(np.linalg.eigvalsh(v))[::-1][:k]
    assert len(rows) == n * k and {r["n"] for r in rows} == {n}
    by_component = {}
    for r in rows:
        by_component.setdefault(r["component"], {}).setdefault(r["vec_id"], []).append(r["whitened"])
    assert sorted(by_component) == list(range(1, k + 1))
    rank = int((values > 1e-12 * max(values[0], 1e-300)).sum())
    for r in rows:
        if r["component"] <= rank:
            assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(v), rel=1e-9)
            assert r["identity_error"] < 1e-9
        else:
            assert r["whitened"] is None
    ids = [i for i, _ in vectors]
    if len(set(ids)) == n:
        for component in range(1, rank + 1):
            w = np.array([by_component[component][i][0] for i in ids])
            assert abs((w * w).mean() - 1) < 1e-9
            # the eigenvector back from the whitened rows: V u = e u
            u = c.T @ w / n / math.sqrt(values[component - 1])
            assert np.linalg.norm(u) == pytest.approx(1, abs=1e-9)
            assert np.linalg.norm(v @ u - values[component - 1] * u) < 1e-11 * values[0] * dim


@pytest.mark.parametrize("n,dim", [(300, 64), (40, 90), (50, 3), (200, 120)])
def test_against_a_dense_decomposition(spark, n, dim):
    rng = np.random.default_rng(n)
    vectors = [(i, (rng.standard_normal(dim) * np.linspace(3, 0.2, dim)).tolist()) for i in range(n)]
    check(whitening.whiten(frame(spark, vectors)).collect(), vectors)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.standard_normal(5).tolist()) for i in range(30)]
    odd = [(50, None), (51, []), (52, [1.0, None, 2.0, 3.0, 4.0]), (53, [math.nan] * 5), (54, [math.inf, 0, 0, 0, 0]), (55, [1.0, 2.0]), (56, [1e300] * 5)]
    odd = [(i, v and [None if c is None else float(c) for c in v]) for i, v in odd]
    used = [*vectors, (None, vectors[3][1]), (4, vectors[4][1])]
    rows = whitening.whiten(frame(spark, [*used, *odd])).collect()
    assert len(rows) == len(used) * 5 and {r["n"] for r in rows} == {32}
    assert {r["vec_id"] for r in rows} == {i for i, _ in used}
    assert all(r["identity_error"] < 1e-9 for r in rows)
    assert sum(r["vec_id"] == 4 for r in rows) == 10


def test_empty_equal_and_single_rows(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None)])).count() == 0
    for vectors in ([(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        rows = whitening.whiten(frame(spark, vectors)).collect()
        assert len(rows) == 2 * len(vectors)
        assert {(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in rows} == {(0, None, None, None)}


def test_deviation_beyond_64_bits(spark):
    rows = whitening.whiten(frame(spark, [(1, [4e12, 0.0]), (2, [-4e12, 0.0])])).collect()
    assert {int(r["deviation"]) for r in rows} == {(2 * 256 * 10**12) ** 2}


@pytest.mark.parametrize("dim,wanted", [(64, 32), (300, 32), (150, 8)])
def test_solver_counts_products_only(dim, wanted):
    """The solver sees the matrix through products; residuals end at double precision."""
    rng = np.random.default_rng(dim)
    q = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    v = (q * rng.gamma(1, 5, dim)) @ q.T
    widths = []

    def product(block):
        widths.append(block.shape[1])
        return v @ block

    values, units = whitening.jacobi_davidson(product, dim, wanted)
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(v))[::-1][:wanted], rtol=1e-12)
    assert np.linalg.norm(v @ units - units * values, axis=0).max() <= 2 * whitening.TOLERANCE * values[0]
    assert np.abs(units.T @ units - np.eye(wanted)).max() < 1e-12
    assert max(widths) <= wanted + whitening.SPARE


def test_inner_solver_solves_the_projected_equation():
    rng = np.random.default_rng(7)
    a = rng.standard_normal((40, 40))
    v, q = a @ a.T, np.linalg.qr(rng.standard_normal((40, 3)))[0]
    p = np.eye(40) - q @ q.T
    right = p @ rng.standard_normal((40, 2))
    shifts = np.array([5.0, 500.0])
    found = whitening.minres(lambda b: v @ b, shifts, q, right, steps=300)
    for j in range(2):
        left = p @ (v - shifts[j] * np.eye(40)) @ p @ found[:, j]
        assert np.linalg.norm(left - right[:, j]) <= 2e-3 * np.linalg.norm(right[:, j])


def test_query_on_the_whole_table(spark):
    path = os.path.join(compare.DATA, "sf0.001")
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    check(queries.op12_whitening(spark, path).collect(), vectors)
