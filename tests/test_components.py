"""Truncated SVD of all folds against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stopwise.operators import components


@pytest.fixture(scope="module")
def folds(spark):
    """Two folds with a quickly falling spectrum, one of them with fewer terms than components."""
    rng = np.random.default_rng(0)
    matrices = {"a": (rng.random((300, 60)) < 0.4) * rng.random((300, 60)) / 2 ** np.arange(60), "b": rng.random((40, 7)) / 3 ** np.arange(7)}
    entries, roles = [], []
    for fold, m in matrices.items():
        for i in range(len(m)):
            roles.append((fold, i, "train" if i % 3 else "valid"))
            entries += [(fold, i, j, float(m[i, j])) for j in range(m.shape[1]) if m[i, j]]
    weights = spark.createDataFrame(entries, "fold string, row_id long, term_id int, weight double")
    return matrices, weights, spark.createDataFrame(roles, "fold string, row_id long, role string")


def test_components_equal_a_dense_decomposition(folds, monkeypatch):
    monkeypatch.setattr(components, "BLOCK_ENTRIES", 1000)
    monkeypatch.setattr(components, "STRIP", 64)
    matrices, weights, roles = folds
    blocks = components.pack_rows(weights, roles)
    assert blocks.where("fold = 'a'").count() > 4
    sizes = weights.groupBy("fold").agg((F.max("term_id") + 1).alias("size"))
    basis = components.fold_components(blocks, sizes, 10)
    scores = components.project(blocks, basis)
    moments = components.column_moments(weights, roles)
    explained = {(r["fold"], r["component"]): r["explained"] for r in components.explained(scores, moments).collect()}
    got = {r["fold"]: r for r in basis.collect()}
    assert {r["fold"]: r["components"] for r in components.orthonormality(basis).where("error < 1e-12").collect()} == {"a": 10, "b": 7}
    for fold, m in matrices.items():
        train = m[np.arange(len(m)) % 3 > 0]
        k = min(10, m.shape[1])
        exact = np.linalg.svd(train, compute_uv=False)[:k]
        assert np.allclose(got[fold]["singular"], exact, rtol=1e-9, atol=1e-12)
        v = np.frombuffer(got[fold]["basis"]).reshape(m.shape[1], k)
        own = {r["row_id"]: r["score"] for r in scores.where(F.col("fold") == fold).collect()}
        assert all(np.allclose(own[i], m[i] @ v) for i in own) and len(own) == (m != 0).any(1).sum()
        total = next(r for r in moments.collect() if r["fold"] == fold)
        assert total["variance"] == pytest.approx(train.var(0).sum()) and total["trace"] == pytest.approx((train**2).sum())
        assert [explained[fold, j] for j in range(k)] == pytest.approx(((train @ v).var(0) / train.var(0).sum()).tolist())
