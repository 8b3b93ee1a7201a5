"""Stopping policy, threshold grids and what happens after the stop.

Decisions kept where the policy leaves room: prefixes are ordered by index, a head passes when its
score is at or above its threshold, and when both heads pass at one prefix the higher score wins,
success on a tie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopwise import fixed
from stopwise.functions import stats

DECISION_FIELDS = ("threshold", "decision", "decision_step", "decision_score", "saved_steps")


def _head_columns(success_thr: float, failure_thr: float, min_step: int, mode: str, tag: str) -> list[Column]:
    step, late = F.col("prefix_step_idx"), F.col("prefix_step_idx") >= min_step
    out = []
    for head, thr in (("success", success_thr), ("failure", failure_thr)):
        score = F.col(f"p_{head}")
        enabled = F.lit(mode in ("dual", f"{head}_only"))
        at = F.when(enabled & late & (score >= thr), step)
        out += [
            F.min(at).alias(f"{head}_step_{tag}"),
            F.min_by(score, at).alias(f"{head}_score_{tag}"),
        ]
    return out


def _choose(tag: str, threshold: float) -> Column:
    """One decision struct from the first passing prefix of each head."""
    ss, fs = F.col(f"success_step_{tag}"), F.col(f"failure_step_{tag}")
    sp, fp = F.col(f"success_score_{tag}"), F.col(f"failure_score_{tag}")
    success = ss.isNotNull() & (fs.isNull() | (ss < fs) | ((ss == fs) & (sp >= fp)))
    step = F.when(success, ss).otherwise(fs)
    return F.struct(
        F.lit(threshold).alias("threshold"),
        F.when(success, "success").when(fs.isNotNull(), "failure").otherwise("undecided").alias("decision"),
        F.coalesce(step, F.lit(-1)).alias("decision_step"),
        F.when(success, sp).otherwise(fp).alias("decision_score"),
        F.coalesce(F.greatest(F.col("n_steps_total") - step, F.lit(0)), F.lit(0)).alias("saved_steps"),
    )


def policy_grid(
    preds: DataFrame,
    thresholds: Sequence[float],
    runs: DataFrame | None = None,
    min_step: int = 0,
    mode: str = "dual",
    keys: Sequence[str] = ("traj_id",),
) -> DataFrame:
    """Decisions of every threshold from one scan and one hash aggregate over the predictions.

    All thresholds are aggregated side by side, so the shuffle carries one small row per run and
    input partition no matter how many thresholds or prefixes there are. With ``runs`` the result
    also holds runs that were never scored, as undecided.
    """
    keys = list(keys)
    aggs = [
        F.count(F.lit(1)).alias("n_prefix_rows"),
        F.max("n_steps_total").alias("n_steps_total"),
    ]
    for i, thr in enumerate(thresholds):
        aggs += _head_columns(thr, thr, min_step, mode, str(i))
    wide = preds.groupBy(*keys).agg(*aggs)
    if runs is not None:
        wide = runs.join(wide, keys, "left").withColumns(
            {
                "n_prefix_rows": F.coalesce("n_prefix_rows", F.lit(0)),
                "n_steps_total": F.coalesce("n_steps_total", F.lit(0)),
            }
        )
    carried = list(runs.columns) if runs is not None else keys
    chosen = F.array(*[_choose(str(i), thr) for i, thr in enumerate(thresholds)])
    return wide.select(*carried, "n_prefix_rows", "n_steps_total", F.inline(chosen)).withColumn(
        "decided", F.col("decision") != "undecided"
    )


def apply_stop_policy(
    preds: DataFrame,
    runs: DataFrame | None = None,
    threshold: float = fixed.PRIMARY_THRESHOLD,
    min_step: int = 0,
    consecutive: int = 1,
    mode: str = "dual",
) -> DataFrame:
    """First crossing per run, or the first run of ``consecutive`` successive crossings."""
    if consecutive <= 1:
        return policy_grid(preds, [threshold], runs, min_step, mode).drop("threshold")
    counted = preds.groupBy("traj_id").agg(
        F.count(F.lit(1)).alias("n_prefix_rows"), F.max("n_steps_total").alias("n_steps_total")
    )
    hits = streaks(preds, threshold, min_step, consecutive, mode)
    first = hits.groupBy("traj_id").agg(
        *[
            agg
            for head in fixed.HEADS
            for at in [F.when(F.col("head") == head, F.col("end_step"))]
            for agg in (
                F.min(at).alias(f"{head}_step_0"),
                F.min_by("end_score", at).alias(f"{head}_score_0"),
            )
        ]
    )
    wide = counted.join(first, "traj_id", "left")
    carried = ["traj_id"]
    if runs is not None:
        carried = runs.columns
        wide = runs.join(wide, "traj_id", "left")
    wide = wide.withColumns(
        {
            "n_prefix_rows": F.coalesce("n_prefix_rows", F.lit(0)),
            "n_steps_total": F.coalesce("n_steps_total", F.lit(0)),
        }
    )
    return (
        wide.select(*carried, "n_prefix_rows", "n_steps_total", F.inline(F.array(_choose("0", threshold))))
        .withColumn("decided", F.col("decision") != "undecided")
        .drop("threshold")
    )


def streaks(preds: DataFrame, threshold: float, min_step: int, consecutive: int, mode: str = "dual") -> DataFrame:
    """Every window of ``consecutive`` successive prefixes that all pass.

    Each passing prefix votes for the windows it belongs to; a window with all its votes is a
    streak. This is a hash aggregate on (run, head, window), so one very long run is spread over
    many tasks, unlike an ordered window over the run.
    """
    heads = ["success", "failure"] if mode == "dual" else [mode.removesuffix("_only")]
    passing = preds.select(
        "traj_id",
        F.col("prefix_step_idx").alias("step"),
        F.inline(F.array(*[F.struct(F.lit(h).alias("head"), F.col(f"p_{h}").alias("score")) for h in heads])),
    ).where((F.col("score") >= threshold) & (F.col("step") >= min_step))
    votes = passing.select(
        "traj_id", "head", "step", "score", F.explode(F.sequence(F.lit(0), F.lit(consecutive - 1))).alias("back")
    ).withColumn("start", F.col("step") - F.col("back"))
    return (
        votes.groupBy("traj_id", "head", "start")
        .agg(F.count(F.lit(1)).alias("votes"), F.max("step").alias("end_step"), F.max_by("score", "step").alias("end_score"))
        .where(F.col("votes") == consecutive)
        .select("traj_id", "head", "end_step", "end_score")
    )


def longest_streaks(preds: DataFrame, threshold: float) -> DataFrame:
    """Gaps and islands of passing prefixes: the longest streak of each head per run."""
    long = preds.select(
        "traj_id",
        "prefix_step_idx",
        F.inline(F.array(*[F.struct(F.lit(h).alias("head"), F.col(f"p_{h}").alias("score")) for h in fixed.HEADS])),
    ).where(F.col("score") >= threshold)
    order = Window.partitionBy("traj_id", "head").orderBy("prefix_step_idx")
    island = long.withColumn("island", F.col("prefix_step_idx") - F.row_number().over(order))
    sizes = island.groupBy("traj_id", "head", "island").agg(
        F.count(F.lit(1)).alias("length"), F.min("prefix_step_idx").alias("first_step")
    )
    return sizes.groupBy("traj_id", "head").agg(
        F.count(F.lit(1)).alias("n_streaks"), F.max("length").alias("longest"), F.min("first_step").alias("first_hit")
    )


def stop_point_scores(decisions: DataFrame, preds: DataFrame) -> DataFrame:
    """Attach the chosen head's score at the stopping prefix, read back from the predictions."""
    point = preds.select("traj_id", F.col("prefix_step_idx").alias("decision_step"), "p_success", "p_failure")
    joined = decisions.where("decided").join(point, ["traj_id", "decision_step"], "left")
    return joined.withColumn(
        "stop_score", F.when(F.col("decision") == "success", F.col("p_success")).otherwise(F.col("p_failure"))
    ).drop("p_success", "p_failure")


def stop_join_report(scored: DataFrame) -> DataFrame:
    diff = F.abs(F.col("stop_score") - F.col("decision_score"))
    return scored.groupBy("model_id", "decision").agg(
        F.count(F.lit(1)).alias("decided"),
        F.count_if(F.col("stop_score").isNull()).alias("missing"),
        F.max(diff).alias("max_abs_difference"),
    )


def classify_outcome(decision="decision", resolved="resolved") -> Column:
    d, r = F.col(decision), F.col(resolved)
    return (
        F.when(d == "undecided", "NO_STOP")
        .when(d == "success", F.when(r == 1, "CORRECT_SUCCESS").otherwise("FALSE_SUCCESS"))
        .otherwise(F.when(r == 0, "CORRECT_FAILURE").otherwise("FALSE_FAILURE"))
    )


def is_correct(decision="decision", resolved="resolved") -> Column:
    """1 or 0 for decided runs, NULL for undecided ones."""
    d, r = F.col(decision), F.col(resolved)
    return F.when(d == "success", (r == 1).cast("int")).when(d == "failure", (r == 0).cast("int"))


def outcomes(decisions: DataFrame, events: DataFrame) -> DataFrame:
    """Run-level outcome table: decision, class, fraction and post-stop evidence."""
    tail = scan_post_stop(decisions, events)
    joined = decisions.join(tail, "traj_id", "left")
    return joined.withColumns(
        {
            "outcome_class": classify_outcome(),
            "correct": is_correct(),
            "decision_fraction": F.when(F.col("decided"), stats.ratio("decision_step", "n_steps_total")),
            "fraction_bin": F.when(F.col("decided"), stats.fraction_bin("decision_step", "n_steps_total")),
            **signatures(),
        }
    )


def scan_post_stop(decisions: DataFrame, events: DataFrame) -> DataFrame:
    """Evidence in the steps after the stop, one row per decided run, also when nothing follows.

    Only the key and the stop step of the decisions travel; the step condition is a residual
    predicate of the equi join, and the flags are combined by one aggregate on the join key.
    """
    stops = decisions.where("decided").select("traj_id", "decision_step")
    tail = stops.join(
        events, (stops.traj_id == events.traj_id) & (events.step_idx > stops.decision_step), "left"
    ).drop(events.traj_id)
    seen = F.col("step_idx").isNotNull()
    flag = lambda name: F.coalesce(F.bool_or(F.col(name)), F.lit(False))
    return tail.groupBy("traj_id").agg(
        F.bool_or(seen).alias("post_activity"),
        flag("is_edit").alias("post_edit"),
        flag("is_test").alias("post_test"),
        flag("is_test_pass").alias("post_test_pass"),
        flag("is_test_fail").alias("post_test_fail"),
        flag("is_error").alias("post_error"),
        flag("is_submit").alias("post_submission"),
        F.count_if(F.coalesce("is_edit", F.lit(False))).alias("post_edit_count"),
        F.count_if(F.coalesce("is_test", F.lit(False))).alias("post_test_count"),
        F.count_if(seen).alias("post_steps"),
        F.when(~F.bool_or(seen), "NOT_OBSERVABLE")
        .when(flag("is_test_pass"), "TRUE")
        .otherwise("FALSE")
        .alias("first_test_pass_after_stop"),
    )


def signatures() -> dict[str, Column]:
    """Late recovery after a failure call, late collapse after a success call; NULL if undecided."""
    return {
        "ff_signature": F.col("post_edit") & (F.col("post_test_pass") | F.col("post_submission")),
        "fs_signature": F.col("post_test_fail") | F.col("post_error"),
    }


def late_reversals(outcome: DataFrame) -> DataFrame:
    """Long form of the wrong decisions with the signature that belongs to their direction."""
    part = lambda cls, sig: outcome.where(F.col("outcome_class") == cls).select(
        "traj_id", "model_id", "decision_step", F.lit(cls).alias("direction"), F.col(sig).alias("signature")
    )
    return part("FALSE_FAILURE", "ff_signature").unionByName(part("FALSE_SUCCESS", "fs_signature"))


def policy_coverage(decisions: DataFrame, by: Sequence[str] = ("model_id",)) -> DataFrame:
    return decisions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if("decided").alias("decided"),
        F.count_if(~F.col("decided")).alias("no_stop"),
        stats.ratio(F.count_if("decided"), F.count(F.lit(1))).alias("coverage"),
        F.avg("resolved").alias("resolve_rate"),
    )


def savings(decisions: DataFrame, by: Sequence[str] = ("model_id", "threshold")) -> DataFrame:
    """What stopping buys: coverage, precision, decision steps and saved steps."""
    stop = F.when(F.col("decided"), F.col("decision_step"))
    saved = F.when(F.col("decided"), F.col("saved_steps"))
    return decisions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if("decided").alias("decided"),
        stats.ratio(F.count_if("decided"), F.count(F.lit(1))).alias("coverage"),
        F.avg(is_correct()).alias("precision"),
        F.avg(stop).alias("mean_decision_step"),
        F.median(stop).alias("median_decision_step"),
        F.avg(saved).alias("mean_saved_steps"),
        F.coalesce(F.sum(saved), F.lit(0)).alias("total_saved_steps"),
    )


def support_identity(grid: DataFrame, n_thresholds: int, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """Do all thresholds cover the same runs? Runs are counted per key, then per group."""
    per_run = grid.groupBy(*by, "traj_id").agg(F.count_distinct("threshold").alias("n"))
    return per_run.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("n") == n_thresholds).alias("in_all_thresholds"),
        F.bool_and(F.col("n") == n_thresholds).alias("identical"),
    )
