"""Named vectors, the cut of boosted trees, and calibration of many keys at once."""

import math
import random

import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from stopwise.operators import heads


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    out = []
    for i in range(400):
        fold, x, c = "ab"[i % 2], rng.random(), rng.choice(["u", "v", None, "rare"])
        role = ("train", "train", "valid", "test")[i // 2 % 4]
        if c == "rare" and role == "train":
            c = "u"
        out.append((fold, i, role, x, c or heads.MISSING, int(x + rng.gauss(0, 0.3) > 0.5), 1.0 + i % 3))
    return spark.createDataFrame(out, "fold string, row_id long, role string, x double, c string, y int, sample_weight double")


def test_vectors_are_named_and_blocks_join_by_key(spark, rows):
    block = rows.where("row_id % 5 <> 0").select("fold", "row_id", F.array("x", F.lit(2.0)).alias("score"))
    widths = spark.createDataFrame([("a", 2), ("b", 2)], "fold string, width int")
    state = heads.encoder_state(rows, ["x"], ["c"], {"text": widths})
    assert {tuple(r["names"]) for r in state.collect()} == {("x", f"c={heads.MISSING}", "c=u", "c=v", "text_1", "text_2")}
    out = heads.assemble(rows, state, ["x"], ["c"], {"text": block}, ["row_id"])
    for r in out.collect():
        one_hot = [float(v == r["c"]) for v in (heads.MISSING, "u", "v")]
        assert r["features"] == [r["x"], *one_hot, *([r["x"], 2.0] if r["row_id"] % 5 else [0.0, 0.0])]
    good = heads.alignment(rows, out, ["row_id"], "x").collect()
    assert all(r["width_ok"] and r["aligned"] and r["names"] == 6 for r in good)
    moved = out.withColumn("row_id", (F.col("row_id") + 2) % 400)
    assert not any(r["aligned"] for r in heads.alignment(rows, moved, ["row_id"], "x").collect())
    short = out.withColumn("features", F.slice("features", 1, 5))
    assert not any(r["width_ok"] for r in heads.alignment(rows, short, ["row_id"], "x").collect())


def test_cut_keeps_the_first_trees(rows):
    ready = rows.where("fold = 'a'").withColumn("features", array_to_vector(F.array("x")))
    head = heads.train_head(ready, "y", trees=6)
    assert len(head.curve) == 6 and head.best_iteration == 1 + head.curve.index(min(head.curve))
    assert len(head.model.trees) == head.best_iteration
    whole = heads.GBTClassifier(labelCol="y", weightCol="sample_weight", maxIter=6, maxDepth=3, seed=42, cacheNodeIds=False).fit(ready.where("role = 'train'"))
    for trees in (1, 3):
        shorter = heads.cut(whole, trees)
        refit = heads.GBTClassifier(labelCol="y", weightCol="sample_weight", maxIter=trees, maxDepth=3, seed=42, cacheNodeIds=False).fit(ready.where("role = 'train'"))
        scored = [[r[0] for r in m.transform(ready).orderBy("row_id").select(vector_to_array("probability")[1]).collect()] for m in (shorter, refit)]
        assert scored[0] == pytest.approx(scored[1])


def test_calibration_of_all_keys_at_once(spark):
    rng = random.Random(5)
    data = [(k, z, float(rng.random() < 1 / (1 + math.exp(-(a * z + b)))), 1.0 + i % 2) for k, a, b in (("p", 2.0, -1.0), ("q", 0.3, 0.5)) for i, z in enumerate(rng.gauss(0, 2) for _ in range(300))]
    data += [("one", z, 1.0, 1.0) for z in (0.5, -1.0, 27.0)]
    packed = spark.createDataFrame(data, "k string, z double, y double, w double")
    lines = heads.fit_platt(packed, ["k"])
    rest = {r["k"]: r for r in heads.platt_residuals(packed, lines, ["k"]).collect()}
    for k in "pq":
        assert abs(rest[k]["residual"]) < 1e-12 and abs(rest[k]["residual_logit"]) < 1e-12
    # one class only: no finite optimum, but a defined and nearly right line
    assert all(math.isfinite(v) for r in lines.collect() for v in r[1:]) and abs(rest["one"]["residual"]) < 0.05
    assert heads.fit_platt(packed.where("false"), ["k"]).count() == 0
