"""Equal rows are packed before heads are trained; step values are counted in one pass."""

import pytest
from pyspark.sql import functions as F

from stopwise.operators import coverage as cov
from stopwise.operators import folds, heads


def test_packed_rows_train_the_same_heads(spark):
    data = [("a", ("train", "train", "valid", "test")[i // 3 % 4], [float(i % 5), float(i % 3)], 0.5, int(i % 5 > 2) ^ int(i % 11 == 0)) for i in range(240)]
    rows = spark.createDataFrame(data, "fold string, role string, features array<double>, sample_weight double, target_success int").withColumn("target_failure", 1 - F.col("target_success"))
    packed = heads.pack(rows)
    assert packed.count() < 100 and packed.agg(F.sum("copies")).first()[0] == 240
    weighted = packed.withColumn("sample_weight", F.col("sample_weight") * F.col("copies"))
    summary = []
    for some, keys, copies in ((rows, [], None), (weighted, ["copies"], "copies")):
        scores, fits = heads.train_dual_heads(some, ["a"], keys, trees=3)
        found = folds.calibration_summary(scores.select("fold", "head", "role", F.col("prob_cal").alias("p"), F.col("target").alias("y"), *keys), copies)
        summary.append((sorted(fits), [tuple(r) for r in found.orderBy("head", "role").collect()]))
    assert summary[0][0] == summary[1][0]
    for one, other in zip(summary[0][1], summary[1][1], strict=True):
        assert one[:4] == other[:4] and one[4:] == pytest.approx(other[4:], abs=1e-9)


def test_fold_statistics_are_broadcast(spark):
    rows = spark.createDataFrame([("ab"[i % 2], "train", i, "cd"[i % 2]) for i in range(100)], "fold string, role string, x long, c string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = folds.dense_features(rows, ["x"], [], ["c"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_step_values_are_parsed_in_one_pass(spark):
    steps = '[{"src":"user","msg":"x","tools":null},{"src":"agent","tools":[{"fn":"b"},{"fn":null},{"fn":"a"}]},{"tools":[{"fn":"a"}]}]'
    rows = spark.createDataFrame([(steps, True, 3), (steps, False, 3)], "steps string, usable boolean, n_steps int")
    got = {(r.kind, r.value): r.n for r in cov.step_histograms(rows, top=1).collect()}
    assert got == {("key", "src"): 2, ("key", "msg"): 1, ("key", "tools"): 3, ("src", "user"): 1, ("src", "agent"): 1, ("src", "None"): 1, ("length", "3"): 1, ("tool", "a"): 2}
