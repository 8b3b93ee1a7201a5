"""Reconciliation of tables and files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.operators import policy


def join_many_to_one(left: DataFrame, right: DataFrame, on: Sequence[str], label: str) -> DataFrame:
    """Left equi join that reports missing partners, label mismatches and repeated right keys.

    Repeats are counted per key before the join and carried along, so a broken right side shows up
    in the report instead of multiplying rows unnoticed.
    """
    counted = right.groupBy(*on).agg(F.count(F.lit(1)).alias("copies"), F.min(label).alias("right_label"))
    return left.join(counted, list(on), "left").withColumns(
        {
            "missing": F.col("copies").isNull(),
            "repeated": F.coalesce(F.col("copies") > 1, F.lit(False)),
            "mismatch": F.coalesce(F.col(label) != F.col("right_label"), F.lit(False)),
        }
    )


def join_report(joined: DataFrame) -> DataFrame:
    return joined.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("missing").alias("missing"),
        F.count_if("repeated").alias("repeated"),
        F.count_if("mismatch").alias("mismatched"),
    )


def _joined(frozen: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    a = frozen.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(True).alias("in_a"))
    b = new.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("in_b"))
    return a.join(b, list(keys), "full_outer")


def reconcile(
    frozen: DataFrame, new: DataFrame, keys: Sequence[str], equal: Sequence[str], numbers: Sequence[str] = (), by: Sequence[str] = ()
) -> DataFrame:
    """Rows on one side only, disagreements per field and largest numeric differences."""
    both = F.col("in_a") & F.col("in_b")
    joined = _joined(frozen, new, keys, [*equal, *numbers])
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("keys"),
        F.count_if(F.col("in_b").isNull()).alias("left_only"),
        F.count_if(F.col("in_a").isNull()).alias("right_only"),
        F.count_if(both).alias("matched"),
        *[F.count_if(both & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(f"{c}_mismatches") for c in equal],
        *[F.max(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))).alias(f"{c}_max_difference") for c in numbers],
    )


def identity_check(
    new: DataFrame, ref: DataFrame, keys: Sequence[str], counts: Sequence[str], numbers: Sequence[str], tolerance: float
) -> DataFrame:
    """One row per column: largest difference or mismatch count, and whether it is within tolerance."""
    wide = reconcile(ref, new, keys, counts, numbers)
    rows = [
        F.struct(F.lit(c).alias("field"), F.col(f"{c}_mismatches").cast("double").alias("difference"), (F.col(f"{c}_mismatches") == 0).alias("passed"))
        for c in counts
    ] + [
        F.struct(
            F.lit(c).alias("field"),
            F.col(f"{c}_max_difference").alias("difference"),
            F.coalesce(F.col(f"{c}_max_difference") <= tolerance, F.lit(False)).alias("passed"),
        )
        for c in numbers
    ]
    return wide.select("left_only", "right_only", F.inline(F.array(*rows)))


def decision_reproduction(frozen: DataFrame, new: DataFrame) -> DataFrame:
    """Do two decision tables agree row by row, per model and threshold?"""
    return reconcile(
        frozen, new, ["threshold", "model_id", "traj_id"], ["decided", "decision", "decision_step", "saved_steps"], ["decision_score"],
        ["threshold", "model_id"],
    )


def prediction_parity(a: DataFrame, b: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    numbers = ["p_success", "p_failure"]
    joined = _joined(a, b, ["traj_id", "prefix_step_idx"], numbers)
    diff = F.greatest(*[F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in numbers])
    return joined.agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(diff).alias("max_difference"),
        F.count_if(diff > tolerance).alias("rows_over_tolerance"),
        F.bool_and(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("ids_equal"),
    )


RECHECKED = ("post_activity", "post_edit", "post_test", "post_test_pass", "post_test_fail", "post_error", "post_submission")


def detector_recheck(stored: DataFrame, decisions: DataFrame, events: DataFrame) -> DataFrame:
    """Post-stop flags derived anew against the stored ones; counts are compared as booleans."""
    fresh = policy.scan_post_stop(decisions, events)
    joined = _joined(stored, fresh, ["traj_id"], [*RECHECKED, "post_edit_count", "post_test_count"])
    as_flag = {"post_edit_count", "post_test_count"}
    rows = []
    for c in (*RECHECKED, "post_edit_count", "post_test_count"):
        a, b = F.col(f"a_{c}"), F.col(f"b_{c}")
        a, b = (a > 0, b > 0) if c in as_flag else (a, b)
        rows.append(F.struct(F.lit(c).alias("event"), (~a.eqNullSafe(b)).cast("int").alias("differs"), F.coalesce(b, F.lit(False)).cast("int").alias("hit")))
    return joined.select(F.inline(F.array(*rows))).groupBy("event").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("hit").alias("hits"), F.sum("differs").alias("mismatches")
    )


def policy_forensic(decisions: DataFrame, preds: DataFrame) -> DataFrame:
    """Prefix rows per run against the decision table, and the offset to the declared length."""
    counted = preds.groupBy("traj_id").agg(F.count(F.lit(1)).alias("prefix_rows"), F.max("n_steps_total").alias("declared"))
    joined = decisions.join(counted, "traj_id", "left").withColumn("class", policy.classify_outcome())
    rows = F.coalesce("prefix_rows", F.lit(0))
    return joined.groupBy("class").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(rows == F.col("n_prefix_rows")).alias("rows_match"),
        F.count_if(F.col("declared") + 1 == rows).alias("one_more_prefix"),
        F.avg(F.col("declared") - rows).alias("mean_offset"),
    )


def manifest_join(observed: DataFrame, recorded: DataFrame) -> DataFrame:
    """Digests found against digests recorded, file by file."""
    a = recorded.select("file", F.col("sha256").alias("expected"))
    b = observed.select("file", F.col("sha256").alias("found"))
    return a.join(b, "file", "full_outer").withColumn(
        "state",
        F.when(F.col("found").isNull(), "MISSING")
        .when(F.col("expected").isNull(), "UNLISTED")
        .when(F.col("found") == F.col("expected"), "MATCH")
        .otherwise("MISMATCH"),
    )


def verify_manifest(observed: DataFrame, recorded: DataFrame) -> DataFrame:
    states = manifest_join(observed, recorded)
    one = lambda s: F.count_if(F.col("state") == s)
    return states.agg(
        F.count(F.lit(1)).alias("files"),
        one("MATCH").alias("matched"),
        one("MISSING").alias("missing"),
        one("MISMATCH").alias("mismatched"),
        one("UNLISTED").alias("unlisted"),
        (one("MATCH") == F.count(F.lit(1))).alias("all_match"),
    )
