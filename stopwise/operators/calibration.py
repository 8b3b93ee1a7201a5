"""Label priors, calibration gaps before and after prior correction, and their spread."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopwise import fixed
from stopwise.functions import stats
from stopwise.operators import policy


def prior_table(runs: DataFrame, group: str = "model_id") -> DataFrame:
    """Success rate of each group and of all the others together.

    The complement is total minus own, on one row per group; raw rows are read once.
    """
    every = Window.partitionBy()
    own = runs.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum("resolved").alias("r"))
    rest_n, rest_r = F.sum("n").over(every) - F.col("n"), F.sum("r").over(every) - F.col("r")
    return own.select(
        group,
        "n",
        "r",
        stats.ratio("r", "n").alias("test_prior"),
        rest_n.alias("train_n"),
        stats.ratio(rest_r, rest_n).alias("train_prior"),
        (stats.ratio("r", "n") - stats.ratio(rest_r, rest_n)).alias("prior_shift"),
    )


def correction_table(priors: DataFrame) -> DataFrame:
    """Log odds ratio of the two priors per group, with the reason where it is degenerate."""
    t, r = F.col("test_prior"), F.col("train_prior")
    odds = lambda p: F.when(p >= 1, F.lit(stats.INF)).otherwise(F.try_divide(p, 1 - p))
    return priors.withColumns(
        {
            "test_odds": odds(t),
            "train_odds": odds(r),
            "log_r": stats.prior_log_ratio(t, r),
            "degenerate": stats.prior_degenerate(t, r),
            "reason": F.when(t == 0, "TEST_PRIOR_ZERO")
            .when(t == 1, "TEST_PRIOR_ONE")
            .when(r == 0, "TRAIN_PRIOR_ZERO")
            .when(r == 1, "TRAIN_PRIOR_ONE")
            .otherwise("NONE"),
        }
    )


def corrected(decisions: DataFrame, coefficients: DataFrame, group: str = "model_id") -> DataFrame:
    """Decided rows with their correctness and the prior-corrected score.

    The coefficient side has one row per group; AQE broadcasts it once its measured size is small.
    """
    scored = decisions.where("decided").join(coefficients.select(group, "log_r", "degenerate"), group)
    return scored.withColumns(
        {
            "correct": policy.is_correct(),
            "p_corrected": stats.shift_score("decision_score", "decision", "log_r"),
        }
    )


def task_cells(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sufficient statistics of decided rows per (group, task, head)."""
    return rows.groupBy(*by, "instance_id", F.col("decision").alias("head")).agg(
        F.count(F.lit(1)).alias("c"),
        F.sum("correct").alias("k"),
        F.sum("decision_score").alias("s"),
        F.sum("p_corrected").alias("sr"),
    )


def gap_columns(n, k, s, sr) -> dict[str, Column]:
    precision = stats.ratio(k, n)
    raw, cor = stats.ratio(s, n), stats.ratio(sr, n)
    return {
        "precision": precision,
        "mean_raw_score": raw,
        "mean_corrected_score": cor,
        "raw_gap": raw - precision,
        "corrected_gap": cor - precision,
        "absorbed_share": stats.ratio(F.abs(raw - precision) - F.abs(cor - precision), F.abs(raw - precision)),
    }


def head_spine(groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per group and head, so that cells without decisions keep their place."""
    heads = F.explode(F.array(*[F.lit(h) for h in fixed.HEADS])).alias("head")
    return groups.select(*by, heads)


def gap_table(rows: DataFrame, groups: DataFrame, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """Calibration gap per group and head, raw and corrected; empty cells stay, with NULL rates."""
    return gap_table_of_cells(task_cells(rows, by), groups, by)


def gap_table_of_cells(cells: DataFrame, groups: DataFrame, by: Sequence[str] = ("model_id",)) -> DataFrame:
    by = list(by)
    sums = cells.groupBy(*by, "head").agg(
        F.sum("c").alias("decisions"),
        F.sum("k").alias("correct"),
        F.sum("s").alias("s"),
        F.sum("sr").alias("sr"),
        F.count(F.lit(1)).alias("distinct_tasks"),
    )
    full = head_spine(groups, by).join(sums, by + ["head"], "left")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("decisions", "correct", "distinct_tasks")}
    return full.withColumns(counts).withColumns(gap_columns("decisions", "correct", "s", "sr")).drop("s", "sr")


def calibration_table(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Score minus precision per model and head, and pooled over models, in one grouping-set pass."""
    sums = (
        rows.groupBy("model_id", F.col("decision").alias("head"))
        .agg(F.count(F.lit(1)).alias("c"), F.sum("correct").alias("k"), F.sum("decision_score").alias("s"))
        .groupingSets([["model_id", "head"], ["head"]], "model_id", "head")
        .agg(F.sum("c").alias("decisions"), F.sum("k").alias("correct"), F.sum("s").alias("s"))
        .withColumn("model_id", F.coalesce("model_id", F.lit("__POOLED__")))
    )
    models = groups.select("model_id").unionByName(
        groups.sparkSession.range(1).select(F.lit("__POOLED__").alias("model_id"))
    )
    gap = stats.ratio("s", "decisions") - stats.ratio("correct", "decisions")
    return (
        head_spine(models, ["model_id"])
        .join(sums, ["model_id", "head"], "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("decisions", "correct")})
        .withColumns(
            {
                "precision": stats.ratio("correct", "decisions"),
                "mean_score": stats.ratio("s", "decisions"),
                "gap": gap,
                "abs_gap": F.abs(gap),
                "enough": F.col("decisions") >= fixed.MIN_DECISIONS,
                "large": F.coalesce(F.abs(gap) >= fixed.LARGE_GAP, F.lit(False)),
            }
        )
        .drop("s")
    )


def reliability_table(decisions: DataFrame, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """Decisions, correct, false, precision and error of both heads per group, one aggregate."""
    cls = policy.classify_outcome()
    n = lambda *names: F.count_if(cls.isin(*names))
    cs, fs, cf, ff = (n(x) for x in ("CORRECT_SUCCESS", "FALSE_SUCCESS", "CORRECT_FAILURE", "FALSE_FAILURE"))
    return decisions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"),
        (cs + fs).alias("success_decisions"),
        cs.alias("success_correct"),
        fs.alias("success_false"),
        stats.ratio(cs, cs + fs).alias("success_precision"),
        stats.ratio(fs, cs + fs).alias("success_error"),
        (cf + ff).alias("failure_decisions"),
        cf.alias("failure_correct"),
        ff.alias("failure_false"),
        stats.ratio(cf, cf + ff).alias("failure_precision"),
        stats.ratio(ff, cf + ff).alias("failure_error"),
        n("NO_STOP").alias("no_stop"),
        F.count_if(F.col("resolved") == 0).alias("final_failures"),
    )


def by_head(reliability: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    """Long form of the reliability table: one row per group and head."""
    part = lambda h: F.struct(
        F.lit(h).alias("head"),
        F.col(f"{h}_decisions").alias("n"),
        F.col(f"{h}_correct").alias("correct"),
        F.col(f"{h}_false").alias("wrong"),
        F.col(f"{h}_precision").alias("precision"),
        F.col(f"{h}_error").alias("error"),
    )
    return reliability.select(*keys, F.inline(F.array(*[part(h) for h in fixed.HEADS])))


def wilson_long(long: DataFrame) -> DataFrame:
    """Wilson intervals of precision and of error, one row per (group, head, rate)."""
    out = long.select(
        "model_id",
        F.col("n").alias("denominator"),
        F.inline(
            F.array(
                F.struct(F.concat("head", F.lit("_precision")).alias("rate_name"), F.col("correct").alias("k")),
                F.struct(F.concat("head", F.lit("_error")).alias("rate_name"), F.col("wrong").alias("k")),
            )
        ),
    )
    low, high = stats.wilson("k", "denominator")
    return out.withColumns({"rate": stats.ratio("k", "denominator"), "lower": low, "upper": high})


def heterogeneity(long: DataFrame, exclude: Sequence[str] = (), value: str = "precision") -> DataFrame:
    """Spread over models per head; ties at an extreme go to the smallest model name."""
    kept = long.where(~F.col("model_id").isin(*exclude)) if exclude else long
    kept = kept.where(F.col(value).isNotNull())
    first = Window.partitionBy("head").orderBy("model_id")
    ranked = kept.withColumn("pos", F.row_number().over(first))
    high = F.max_by("model_id", F.struct(F.col(value), -F.col("pos")))
    low = F.min_by("model_id", F.struct(F.col(value), F.col("pos")))
    return ranked.groupBy("head").agg(
        F.count(F.lit(1)).alias("models"),
        F.max(value).alias("max_value"),
        F.min(value).alias("min_value"),
        (F.max(value) - F.min(value)).alias("value_range"),
        F.stddev_pop(value).alias("std_dev"),
        high.alias("argmax_model"),
        low.alias("argmin_model"),
    )


def residual_range(gaps: DataFrame) -> DataFrame:
    """Range of the raw and corrected gaps over non-degenerate models with decisions."""
    used = gaps.where(~F.col("degenerate") & (F.col("decisions") > 0))
    raw = F.max("raw_gap") - F.min("raw_gap")
    res = F.max("corrected_gap") - F.min("corrected_gap")
    return used.groupBy("head").agg(
        F.count(F.lit(1)).alias("models"),
        raw.alias("raw_range"),
        res.alias("residual_range"),
        (raw - res).alias("absorbed"),
        stats.ratio(raw - res, raw).alias("absorbed_share"),
        F.max(F.abs("raw_gap")).alias("max_abs_raw"),
        F.max(F.abs("corrected_gap")).alias("max_abs_residual"),
    )


def pooled_gap(gaps: DataFrame) -> DataFrame:
    """Decision-weighted pooled gap per head, before and after correction."""
    n = F.col("decisions")
    return gaps.where(n > 0).groupBy("head").agg(
        F.sum("decisions").alias("decisions"),
        stats.ratio(F.sum(n * F.col("raw_gap")), F.sum(n)).alias("pooled_raw_gap"),
        stats.ratio(F.sum(n * F.col("corrected_gap")), F.sum(n)).alias("pooled_corrected_gap"),
    )


def head_signal(gaps: DataFrame, by: Sequence[str] = ("head",)) -> DataFrame:
    """Sizes of the corrected gap over eligible targets."""
    used = gaps.where(~F.col("degenerate") & (F.col("decisions") >= fixed.MIN_DECISIONS))
    a = F.abs("corrected_gap")
    return used.groupBy(*by).agg(
        F.count(F.lit(1)).alias("eligible_targets"),
        F.median(a).alias("median_abs_gap"),
        F.max(a).alias("max_abs_gap"),
        (F.max("corrected_gap") - F.min("corrected_gap")).alias("gap_range"),
        F.min("corrected_gap").alias("min_gap"),
        F.max("corrected_gap").alias("max_gap"),
        F.count_if(a >= 0.05).alias("n_ge_005"),
        F.count_if(a >= 0.08).alias("n_ge_008"),
        F.count_if(a >= 0.10).alias("n_ge_010"),
    )


def prior_shift_correlation(priors: DataFrame, long: DataFrame, gaps: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Rank correlation of the prior shift with error rate, raw gap and residual gap, per head."""
    base = (
        priors.select("model_id", "prior_shift", "degenerate")
        .join(long.select("model_id", "head", F.col("error").alias("error_rate")), "model_id")
        .join(gaps.select("model_id", "head", "decisions", "raw_gap", "corrected_gap"), ["model_id", "head"])
    )
    if exclude:
        base = base.where(~F.col("model_id").isin(*exclude))
    base = base.where(F.col("decisions") > 0)
    measures = F.inline(
        F.array(
            *[
                F.struct(F.lit(m).alias("measure"), F.col(m).alias("value"))
                for m in ("error_rate", "raw_gap", "corrected_gap")
            ]
        )
    )
    long_form = base.select("head", "degenerate", "prior_shift", measures)
    usable = long_form.where((F.col("measure") == "error_rate") | ~F.col("degenerate"))
    return stats.spearman(usable, ["head", "measure"], "prior_shift", "value")
