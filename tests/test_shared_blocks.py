"""Shared blocks hold a row once for all folds; products neither shuffle blocks nor copies of V."""

import numpy as np
from pyspark.sql import functions as F

from stopwise.operators import components

COUNTS = [(1, 0, [("aa", 1), ("bb", 3)]), (2, 1, [("bb", 2), ("zz", 9)]), (3, 1, [("zz", 1)])]
VOCAB = [("f", "aa", 0, 1.5), ("f", "bb", 1, 2.0), ("g", "bb", 0, 1.0)]
CELLS = [("f", 0, "train"), ("f", 1, "test"), ("g", 0, "test"), ("g", 1, "train")]


def test_shared_blocks_give_each_fold_its_weights(spark):
    vocab = spark.createDataFrame(VOCAB, "fold string, term string, term_id long, idf double")
    folds = components.Folds.collect(vocab, spark.createDataFrame(CELLS, "fold string, cell int, role string"))
    rows = spark.createDataFrame(COUNTS, "row_id long, cell int, items array<struct<term: string, cnt: long>>").coalesce(1)
    blocks = components.pack_counts(rows, folds)
    assert blocks.count() == 1
    found = {}
    for batch in blocks.toArrow().to_batches():
        for fold, role, block in folds.blocks(batch):
            for i, row in enumerate(block.rows):
                at = slice(block.starts[i], block.starts[i + 1])
                found[fold, role, int(row)] = dict(zip(block.terms[at].tolist(), block.weights[at].tolist()))
    a, b = 1.5, 2 * (1 + np.log(3))
    length = np.hypot(a, b)
    assert set(found) == {("f", "train", 1), ("f", "test", 2), ("g", "test", 1), ("g", "train", 2)}
    assert np.allclose([found["f", "train", 1][0], found["f", "train", 1][1]], [a / length, b / length])
    assert found["f", "test", 2] == {1: 1.0} and found["g", "train", 2] == {0: 1.0}
    sizes = vocab.groupBy("fold").agg((F.max("term_id") + 1).alias("size"))
    basis = components.fold_components(blocks, sizes, 2, folds=folds)
    assert {r["fold"]: round(r["singular"][0], 9) for r in basis.collect()} == {"f": 1.0, "g": 1.0}
    n = spark.createDataFrame([("f", 1), ("g", 2)], "fold string, rows long")
    moments = {r["fold"]: (r["trace"], r["variance"]) for r in components.block_moments(blocks, folds, n).collect()}
    assert np.allclose([moments["f"], moments["g"]], [(1.0, 0.0), (1.0, 0.25)])
    plan = components._gram_times(blocks, basis, 2 + components.SPARE, folds)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and plan.count("Exchange") == 1
