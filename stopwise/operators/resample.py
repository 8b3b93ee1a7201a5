"""Task-cluster bootstrap.

Clusters are drawn with replacement and every row of a drawn cluster comes along, so a replicate is
a weighting of clusters. Draws are hashes of (seed, scope, replicate, draw number): reproducible in
any engine and on any number of executors. Rows are reduced to sums per (cell, cluster) before the
weights reach them, so the work grows with replicates x clusters and not with rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopwise import fixed
from stopwise.functions import stats
from stopwise.operators import lanes, profile
from stopwise.operators.ranking import ordered_ids
from stopwise.session import materialize


def dense_ids(clusters: DataFrame, scope: Sequence[str], key: str = "instance_id") -> DataFrame:
    """Number the clusters of each scope 0 .. n-1 without sorting a scope in one task.

    Names are split over 256 hash buckets.
    """
    named = clusters.select(*scope, key).distinct()
    bucket = F.substring(F.md5(F.col(key).cast("binary")), 1, 2)
    return ordered_ids(named, scope, key, bucket, "id").withColumnRenamed("id_total", "n")


def weights(
    clusters: DataFrame, scope: Sequence[str], replicates: int, seed: Column | int, key: str = "instance_id"
) -> DataFrame:
    """How often each cluster is drawn in each replicate; clusters not drawn have no row."""
    scope = list(scope)
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    spread = clusters.sparkSession.sparkContext.defaultParallelism
    ids = materialize(dense_ids(clusters, scope, key), "clusters")
    text = F.concat_ws("|", seed.cast("string"), *[F.col(c).cast("string") for c in scope], F.col("rep").cast("string"), F.col("id").cast("string"))
    drawn = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % F.col("n")
    draws = (
        ids.repartition(spread, *scope, "id")
        .withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
        .select(*scope, "rep", drawn.alias("id"))
    )
    counts = draws.groupBy(*scope, "rep", "id").agg(F.count(F.lit(1)).alias("w"))
    return counts.join(ids.select(*scope, key, "id"), scope + ["id"]).select(*scope, "rep", key, "w")


def replicate_sums(
    weight: DataFrame, cells: DataFrame, on: Sequence[str], by: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Weighted sums of cell columns per replicate."""
    w = F.col("w")
    return weight.join(cells, list(on)).groupBy("rep", *by).agg(*[F.sum(w * F.col(c)).alias(c) for c in columns])


def intervals(long: DataFrame, by: Sequence[str] = ("statistic",), value: str = "value") -> DataFrame:
    return long.groupBy(*by).agg(*stats.interval(value))


def _statistics(df: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    items = [F.struct(F.lit(n).alias("statistic"), F.col(n).cast("double").alias("value")) for n in names]
    return df.select(*by, "rep", F.inline(F.array(*items)))


def confusion_bootstrap(outcome: DataFrame, tasks: DataFrame, replicates: int = fixed.REPLICATES, seed: int = fixed.SEED) -> DataFrame:
    """Error rates and signature risk differences, one draw shared by all models."""
    cells = (
        profile.with_direction(outcome)
        .groupBy("instance_id", "direction", "model_id", "fraction_bin")
        .agg(
            F.count_if("is_error").alias("ec"),
            F.count_if(~F.col("is_error")).alias("cc"),
            F.count_if(F.col("is_error") & F.col("signature")).alias("ek"),
            F.count_if(~F.col("is_error") & F.col("signature")).alias("ck"),
        )
    )
    strata = replicate_sums(
        weights(tasks, [], replicates, seed), cells, ["instance_id"], ["direction", "model_id", "fraction_bin"], ["ec", "cc", "ek", "ck"]
    )
    per_rep = profile.standardize(strata, ["rep", "direction"])
    of = lambda d, c: F.max(F.when(F.col("direction") == d, c))
    raw = F.col("raw_error_rate") - F.col("raw_control_rate")
    rate = stats.ratio("n_error", F.col("n_error") + F.col("n_control"))
    wide = per_rep.groupBy("rep").agg(
        of("FALSE_SUCCESS", rate).alias("success_error_rate"),
        of("FALSE_FAILURE", rate).alias("failure_error_rate"),
        of("FALSE_SUCCESS", raw).alias("fs_risk_difference_raw"),
        of("FALSE_SUCCESS", F.col("std_risk_difference")).alias("fs_risk_difference_std"),
        of("FALSE_FAILURE", raw).alias("ff_risk_difference_raw"),
        of("FALSE_FAILURE", F.col("std_risk_difference")).alias("ff_risk_difference_std"),
    )
    wide = wide.withColumn("error_rate_difference", F.col("failure_error_rate") - F.col("success_error_rate"))
    return intervals(_statistics(wide, [c for c in wide.columns if c != "rep"]))


def model_task_cells(decisions: DataFrame) -> DataFrame:
    d, r = F.col("decision"), F.col("resolved")
    return decisions.groupBy("model_id", "instance_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("resolved").alias("r"),
        F.count_if(d == "success").alias("sd"),
        F.count_if((d == "success") & (r == 1)).alias("sc"),
        F.count_if(d == "failure").alias("fd"),
        F.count_if((d == "failure") & (r == 0)).alias("fc"),
    )


def _with_prior_shift(per_model: DataFrame) -> DataFrame:
    rep = Window.partitionBy("rep")
    rest_n, rest_r = F.sum("n").over(rep) - F.col("n"), F.sum("r").over(rep) - F.col("r")
    return per_model.withColumn("prior_shift", stats.ratio("r", "n") - stats.ratio(rest_r, rest_n))


def precision_bootstrap(
    decisions: DataFrame,
    tasks: DataFrame,
    replicates: int = fixed.REPLICATES,
    seed: int = fixed.SEED,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Precision ranges over models, and rank correlation of prior shift with error rate."""
    sums = replicate_sums(
        weights(tasks.select("instance_id"), [], replicates, seed),
        model_task_cells(decisions),
        ["instance_id"],
        ["model_id"],
        ["n", "r", "sd", "sc", "fd", "fc"],
    )
    shifted = _with_prior_shift(sums)
    if exclude:
        shifted = shifted.where(~F.col("model_id").isin(*exclude))
    part = lambda h, n, k: F.struct(
        F.lit(h).alias("head"), stats.ratio(k, n).alias("precision"), (1 - stats.ratio(k, n)).alias("error")
    )
    long = shifted.select(
        "rep", "model_id", "prior_shift", F.inline(F.array(part("success", "sd", "sc"), part("failure", "fd", "fc")))
    )
    ranges = long.groupBy("rep", "head").agg((F.max("precision") - F.min("precision")).alias("value"))
    rhos = stats.spearman(long, ["rep", "head"], "prior_shift", "error", "value")
    name = lambda s: F.concat("head", F.lit(s)).alias("statistic")
    both = ranges.select("rep", name("_precision_range"), "value").unionByName(
        rhos.select("rep", name("_rho_prior_shift_error"), "value")
    )
    return intervals(both)


def residual_bootstrap(
    corrected: DataFrame,
    decisions: DataFrame,
    coefficients: DataFrame,
    tasks: DataFrame,
    replicates: int = fixed.REPLICATES,
    seed: int = fixed.SEED,
) -> DataFrame:
    """Raw and residual gap ranges with the coefficient held fixed, and their rank correlations."""
    weight = weights(tasks.select("instance_id"), [], replicates, seed)
    head_sum = lambda h, c: F.coalesce(F.sum(F.when(F.col("decision") == h, F.col(c))), F.lit(0)).alias(f"{h}_{c}")
    rows = corrected.withColumn("one", F.lit(1))
    names = ("one", "correct", "decision_score", "p_corrected")
    scored = rows.groupBy("model_id", "instance_id").agg(*[head_sum(h, c) for h in fixed.HEADS for c in names])
    base = decisions.groupBy("model_id", "instance_id").agg(F.count(F.lit(1)).alias("n"), F.sum("resolved").alias("r"))
    columns = [f"{h}_{c}" for h in fixed.HEADS for c in names]
    cells = base.join(scored, ["model_id", "instance_id"], "left").fillna(0, columns)
    sums = replicate_sums(weight, cells, ["instance_id"], ["model_id"], ["n", "r", *columns])
    shifted = _with_prior_shift(sums).join(coefficients.select("model_id", "degenerate"), "model_id")
    part = lambda h: F.struct(
        F.lit(h).alias("head"),
        (stats.ratio(f"{h}_decision_score", f"{h}_one") - stats.ratio(f"{h}_correct", f"{h}_one")).alias("raw"),
        (stats.ratio(f"{h}_p_corrected", f"{h}_one") - stats.ratio(f"{h}_correct", f"{h}_one")).alias("residual"),
    )
    long = shifted.where(~F.col("degenerate")).select(
        "rep", "model_id", "prior_shift", F.inline(F.array(*[part(h) for h in fixed.HEADS]))
    )
    spread = lambda c: (F.max(c) - F.min(c)).alias(f"{c}_gap_range")
    ranges = long.groupBy("rep", "head").agg(spread("raw"), spread("residual"))
    ranges = _statistics(ranges, ["raw_gap_range", "residual_gap_range"], ["head"])
    rho_raw = stats.spearman(long, ["rep", "head"], "prior_shift", "raw", "value").withColumn("statistic", F.lit("rho_raw"))
    rho_res = stats.spearman(long, ["rep", "head"], "prior_shift", "residual", "value").withColumn("statistic", F.lit("rho_residual"))
    cols = ["head", "rep", "statistic", "value"]
    every = ranges.select(cols).unionByName(rho_raw.select(cols)).unionByName(rho_res.select(cols))
    return intervals(every, ["head", "statistic"])


def pair_bootstrap(
    cells: DataFrame,
    fold_sides: DataFrame,
    common: DataFrame,
    priors: DataFrame,
    replicates: int = fixed.REPLICATES,
    seed: int = fixed.SEED * 100,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Median gap difference between the two sides of a fold, folds resampled independently."""
    heads = F.explode(F.array(*[F.lit(h) for h in fixed.HEADS])).alias("head")
    kept = fold_sides
    if exclude:
        kept = kept.where(~F.col("model_id").isin(*exclude) & ~F.col("partner").isin(*exclude))
    scope = common.join(kept.select("pair_id").distinct(), "pair_id", "left_semi").select("*", heads)
    head_seed = F.lit(seed) + F.when(F.col("head") == "success", 1).otherwise(2)
    weight = weights(scope, ["pair_id", "head"], replicates, head_seed)
    fold_cells = (
        cells.where(F.col("decision") != "undecided")
        .join(kept.select("pair_id", "side", "model_id"), "model_id")
        .join(common, ["pair_id", "instance_id"])
        .join(priors.select("pair_id", "side", "log_r"), ["pair_id", "side"])
        .groupBy("pair_id", F.col("decision").alias("head"), "instance_id")
        .agg(
            *[
                F.coalesce(F.sum(F.when(F.col("side") == s, v)), F.lit(0)).alias(f"{s.lower()}_{name}")
                for s in ("A", "B")
                for name, v in (
                    ("n", F.col("n")),
                    ("k", F.col("k")),
                    ("sr", F.col("n") * stats.shift_score("decision_score", "decision", "log_r")),
                )
            ]
        )
    )
    names = [f"{s}_{c}" for s in "ab" for c in ("n", "k", "sr")]
    sums = replicate_sums(weight, fold_cells, ["pair_id", "head", "instance_id"], ["pair_id", "head"], names)
    gap = lambda s: stats.ratio(f"{s}_sr", f"{s}_n") - stats.ratio(f"{s}_k", f"{s}_n")
    enough = (F.col("a_n") >= fixed.MIN_DECISIONS) & (F.col("b_n") >= fixed.MIN_DECISIONS)
    diffs = sums.where(enough).select("rep", "head", F.abs(gap("a") - gap("b")).alias("difference"))
    medians = diffs.groupBy("head", "rep").agg(F.median("difference").alias("value"))
    return intervals(medians, ["head"])


def target_bootstrap(
    folds: DataFrame,
    common: DataFrame,
    task_priors: DataFrame,
    cells: DataFrame,
    scope: Sequence[str],
    replicates: int,
    seed: Column | int,
    frozen: bool = False,
    min_decisions: int = fixed.MIN_DECISIONS,
) -> DataFrame:
    """Median signed and absolute gap of each target over its folds.

    ``folds`` has one row per target and fold: scope columns, pair_id, side, model_id, head, log_r.
    With ``frozen`` the coefficient stays at its point value. Otherwise it is recomputed in each
    replicate from the same draw, so the corrected score is re-evaluated per distinct score.

    Replicates are the lanes of vectors (``lanes``): a fold's decisions meet its tasks x replicates matrix
    of draw counts once, and only vectors of sums are shuffled, by fold.
    """
    scope = list(scope)
    fold = scope + ["pair_id"]
    tasks = folds.join(common.select("pair_id", "instance_id"), "pair_id")
    drawn = lanes.draw(materialize(dense_ids(tasks, fold), "clusters"), fold, replicates, seed)
    if frozen:
        plan = lanes.fixed_coefficient(drawn, folds.select(*fold, "log_r"), fold, replicates)
    else:
        is_a = F.col("side") == "A"
        sides = folds.join(task_priors, "pair_id").select(
            *fold,
            "instance_id",
            F.when(is_a, F.col("a_n")).otherwise(F.col("b_n")).alias("target_n"),
            F.when(is_a, F.col("a_r")).otherwise(F.col("b_r")).alias("target_r"),
            "train_n",
            "train_r",
        )
        plan = lanes.drawn_coefficient(drawn, sides, fold, replicates)
    plan = materialize(plan, "lanes")
    cell_keys = [c for c in ("threshold",) if c in scope]
    scored = cells.where(F.col("decision") != "undecided").withColumnRenamed("decision", "head")
    fold_cells = folds.join(scored, ["model_id", "head", *cell_keys]).select(
        *fold, "instance_id", "head", "decision_score", "n", "k"
    )
    sums = lanes.corrected_sums(materialize(fold_cells, "fold_cells"), plan, fold, replicates)
    per_rep = lanes.medians(sums, scope, fold, replicates, min_decisions)
    signed, absolute = stats.interval("median_gap"), stats.interval("median_abs_gap")
    return per_rep.groupBy(*scope).agg(
        *signed,
        *[c.alias(f"abs_{n}") for c, n in zip(absolute[1:], ("ci_lower", "ci_median", "ci_upper"))],
        F.count_if("degenerate").alias("degenerate_replicates"),
    )


def cell_bootstrap(
    cells: DataFrame, scope: Sequence[str], replicates: int = fixed.REPLICATES, seed: int = fixed.CELL_SEED
) -> DataFrame:
    """Corrected gap of single (model, head) cells over the tasks that have decisions."""
    scope = list(scope)
    totals = cells.groupBy(*scope).agg(
        F.sum("c").alias("decisions"),
        F.count(F.lit(1)).alias("n_tasks"),
        (stats.ratio(F.sum("sr"), F.sum("c")) - stats.ratio(F.sum("k"), F.sum("c"))).alias("point_gap"),
    )
    enough = totals.where(F.col("decisions") >= fixed.MIN_DECISIONS)
    used = cells.join(enough.select(*scope), scope, "left_semi")
    weight = weights(used.select(*scope, "instance_id"), scope, replicates, seed)
    sums = replicate_sums(weight, used, scope + ["instance_id"], scope, ["c", "k", "sr"])
    gap = stats.ratio("sr", "c") - stats.ratio("k", "c")
    return enough.join(intervals(sums.withColumn("value", gap), scope), scope)
