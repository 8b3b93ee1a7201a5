"""Event detection on steps, and what can be observed after a hypothetical stop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise import fixed


def detect_events(steps: DataFrame) -> DataFrame:
    action = F.coalesce("action_text", F.lit(""))
    both = F.concat(action, F.lit("\n"), F.coalesce("tool_args_text", F.lit("")))
    kinds = F.coalesce("action_subtypes", F.array().cast("array<string>"))
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    return steps.select(
        "traj_id",
        "step_idx",
        both.rlike(fixed.EDIT_PATTERN).alias("is_edit"),
        (F.array_contains(kinds, "test") | action.rlike(fixed.TEST_PATTERN)).alias("is_test"),
        flag("test_pass_seen_this_step").alias("is_test_pass"),
        flag("test_fail_seen_this_step").alias("is_test_fail"),
        (flag("traceback_seen_this_step") | flag("tool_error_seen_this_step")).alias("is_error"),
        (F.array_contains(kinds, "submit") | action.contains(fixed.SUBMIT_MARKER)).alias("is_submit"),
    )


def observability(events: DataFrame) -> DataFrame:
    """For every stop k = 1 .. n-1 of every run: does an event of each kind still follow?

    An event follows k exactly when the last event of its kind lies after k, so each run needs only
    its last step and its last event steps, and the count over k is a closed form of them.
    """
    kinds = {"edit": "is_edit", "test": "is_test", "test_pass": "is_test_pass", "submission": "is_submit"}
    last = events.groupBy("traj_id").agg(
        F.max("step_idx").alias("n"),
        *[F.max(F.when(F.col(c), F.col("step_idx"))).alias(f"last_{k}") for k, c in kinds.items()],
    )
    stops = F.greatest(F.col("n") - 1, F.lit(0))
    seen = lambda c: F.greatest(F.least(F.coalesce(F.col(c), F.lit(0)) - 1, stops), F.lit(0))
    return last.agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum(stops).alias("stop_points"),
        F.sum(stops).alias("late_activity"),
        *[F.sum(seen(f"last_{k}")).alias(f"post_stop_{k}") for k in kinds],
    )


def event_totals(events: DataFrame) -> DataFrame:
    names = ["is_edit", "is_test", "is_test_pass", "is_test_fail", "is_error", "is_submit"]
    return events.groupBy("step_idx").agg(
        F.count(F.lit(1)).alias("steps"), *[F.count_if(n).alias(f"n_{n[3:]}") for n in names]
    )
