"""Two held-out models scored by one predictor: pair folds, common support, occurrences.

Decided rows are first reduced to counts per (model, task, decision, score). That reduction is
exact, since the corrected score depends on the score alone, and only these counts are fanned out
to the folds of a model. The number of folds is quadratic in models, never in rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopwise import fixed
from stopwise.functions import stats
from stopwise.operators import policy


def unordered_pairs(names: DataFrame, key: str) -> DataFrame:
    """All i < j combinations of a dimension's names; the name list is one small sorted array."""
    listed = names.select(key).distinct().agg(F.sort_array(F.collect_list(key)).alias("all"))
    first = listed.select("all", F.posexplode("all").alias("i", "agent_a"))
    rest = F.slice("all", F.col("i") + 2, F.greatest(F.size("all"), F.lit(1)))
    both = first.select("i", "agent_a", F.posexplode(rest).alias("k", "agent_b"))
    # plain numbers with a separator: distinct for any number of names
    pair_id = F.concat_ws("-", F.lit("pair"), F.col("i").cast("string"), (F.col("i") + 1 + F.col("k")).cast("string"))
    return both.select(pair_id.alias("pair_id"), "agent_a", "agent_b")


def sides(pairs: DataFrame) -> DataFrame:
    """Two rows per fold: each held-out model with its partner."""
    row = lambda s, me, other: F.struct(
        F.lit(s).alias("side"), F.col(me).alias("model_id"), F.col(other).alias("partner")
    )
    return pairs.select("pair_id", F.inline(F.array(row("A", "agent_a", "agent_b"), row("B", "agent_b", "agent_a"))))


def model_tasks(runs: DataFrame) -> DataFrame:
    return runs.groupBy("model_id", "instance_id").agg(F.count(F.lit(1)).alias("n"), F.sum("resolved").alias("r"))


def common_tasks(fold_sides: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tasks that both sides of a fold attempted."""
    seen = fold_sides.select("pair_id", "model_id").join(tasks.select("model_id", "instance_id"), "model_id")
    return (
        seen.groupBy("pair_id", "instance_id")
        .agg(F.count(F.lit(1)).alias("sides"))
        .where(F.col("sides") == 2)
        .select("pair_id", "instance_id")
    )


def common_support(fold_sides: DataFrame, tasks: DataFrame) -> DataFrame:
    """Common tasks and matched runs (the smaller count of each task) per fold."""
    per_task = (
        fold_sides.select("pair_id", "model_id")
        .join(tasks, "model_id")
        .groupBy("pair_id", "instance_id")
        .agg(F.count(F.lit(1)).alias("sides"), F.min("n").alias("matched"))
        .where(F.col("sides") == 2)
    )
    return per_task.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("common_tasks"), F.sum("matched").alias("matched_runs")
    )


def fold_task_priors(fold_sides: DataFrame, tasks: DataFrame, common: DataFrame) -> DataFrame:
    """Per fold and common task: runs and successes of side A, side B and all other models."""
    extra = [c for c in common.columns if c not in ("pair_id", "instance_id")]
    joined = common.join(tasks, "instance_id").join(
        fold_sides.select("pair_id", "model_id", "side"), ["pair_id", "model_id"], "left"
    )
    total = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    aggs = []
    for tag, cond in (
        ("train", F.col("side").isNull()),
        ("a", F.col("side") == "A"),
        ("b", F.col("side") == "B"),
    ):
        aggs += [total(cond, "n").alias(f"{tag}_n"), total(cond, "r").alias(f"{tag}_r")]
    return joined.groupBy("pair_id", "instance_id", *extra).agg(*aggs)


def fold_priors(task_priors: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Train and target priors of each fold side on the common support, and the log ratio."""
    names = ["train_n", "train_r", "a_n", "a_r", "b_n", "b_r"]
    summed = task_priors.groupBy("pair_id", *extra).agg(
        F.count(F.lit(1)).alias("n_common_tasks"), *[F.sum(c).alias(c) for c in names]
    )
    row = lambda s: F.struct(
        F.lit(s.upper()).alias("side"), F.col(f"{s}_n").alias("target_n"), F.col(f"{s}_r").alias("target_r")
    )
    long = summed.select(
        "pair_id", *extra, "n_common_tasks", "train_n", "train_r", F.inline(F.array(row("a"), row("b")))
    )
    return with_log_ratio(long)


def with_log_ratio(df: DataFrame) -> DataFrame:
    pi_target, pi_train = stats.ratio("target_r", "target_n"), stats.ratio("train_r", "train_n")
    return df.withColumns(
        {
            "pi_target": pi_target,
            "pi_train": pi_train,
            "log_r": stats.prior_log_ratio(pi_target, pi_train),
            "degenerate": stats.prior_degenerate(pi_target, pi_train),
        }
    )


def score_cells(decisions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Runs per (model, task, decision, score): exact sufficient counts of the decided rows."""
    return decisions.groupBy(*by, "model_id", "instance_id", "decision", "decision_score").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(policy.is_correct()), F.lit(0)).alias("k"),
        F.sum("saved_steps").alias("saved"),
    )


def occurrences(
    cells: DataFrame,
    fold_sides: DataFrame,
    common: DataFrame,
    priors: DataFrame,
    thresholds: Sequence[float] = (),
    extra: Sequence[str] = (),
) -> DataFrame:
    """One row per (fold, side, head): decisions, precision, scores and gaps on the common support.

    With ``thresholds`` the cells carry a threshold column; ``extra`` are columns of the common-task
    frame (task half). Empty cells stay with NULL rates.
    """
    by_cols, extra = (["threshold"] if thresholds else []), list(extra)
    restricted = (
        cells.join(fold_sides.select("pair_id", "side", "model_id"), "model_id")
        .join(common, ["pair_id", "instance_id"])
        .join(priors.select("pair_id", "side", *extra, "log_r"), ["pair_id", "side", *extra])
    )
    n = F.col("n")
    decided = F.col("decision") != "undecided"
    sums = (
        restricted.where(decided)
        .withColumn("p_corrected", stats.shift_score("decision_score", "decision", "log_r"))
        .groupBy(*by_cols, "pair_id", "side", *extra, F.col("decision").alias("head"))
        .agg(
            F.sum(n).alias("decisions"),
            F.sum("k").alias("correct"),
            F.sum(n * F.col("decision_score")).alias("s"),
            F.sum(n * F.col("p_corrected")).alias("sr"),
            F.sum("saved").alias("saved"),
        )
    )
    heads = F.explode(F.array(*[F.lit(h) for h in fixed.HEADS])).alias("head")
    spine = fold_sides.join(priors, ["pair_id", "side"]).select("*", heads)
    if thresholds:
        spine = spine.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in thresholds])))
    full = spine.join(sums, by_cols + ["pair_id", "side", *extra, "head"], "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("decisions", "correct")}
    )
    precision = stats.ratio("correct", "decisions")
    raw, cor = stats.ratio("s", "decisions"), stats.ratio("sr", "decisions")
    fold = Window.partitionBy(*by_cols, *extra, "pair_id", "head")
    return full.withColumns(
        {
            "precision": precision,
            "mean_score": raw,
            "corrected_mean": cor,
            "raw_gap": raw - precision,
            "corrected_gap": cor - precision,
            "mean_saved_steps": stats.ratio("saved", "decisions"),
            "eligible": F.min("decisions").over(fold) >= fixed.MIN_DECISIONS,
        }
    ).drop("s", "sr", "saved")


def all_task_stats(cells: DataFrame, fold_sides: DataFrame) -> DataFrame:
    """The same head statistics without the restriction to common tasks, plus undecided runs."""
    joined = cells.join(fold_sides.select("pair_id", "side", "model_id"), "model_id")
    return joined.groupBy("pair_id", "side", F.col("decision").alias("head")).agg(
        F.sum("n").alias("all_decisions"),
        stats.ratio(F.sum("k"), F.sum("n")).alias("all_precision"),
        (stats.ratio(F.sum(F.col("n") * F.col("decision_score")), F.sum("n")) - stats.ratio(F.sum("k"), F.sum("n"))).alias(
            "all_raw_gap"
        ),
    )


SIDE_COLUMNS = (
    "decisions",
    "correct",
    "precision",
    "mean_score",
    "raw_gap",
    "pi_target",
    "log_r",
    "degenerate",
    "corrected_mean",
    "corrected_gap",
    "all_decisions",
    "all_precision",
    "all_raw_gap",
)


def pairwise_metrics(long: DataFrame, all_tasks: DataFrame) -> DataFrame:
    """One row per (fold, head) with both sides next to each other and their differences."""
    joined = long.join(all_tasks, ["pair_id", "side", "head"], "left").withColumn(
        "all_decisions", F.coalesce("all_decisions", F.lit(0))
    )
    pick = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    wide = joined.groupBy("pair_id", "head", "n_common_tasks", "pi_train", "train_n", "eligible").agg(
        *[pick(s, c).alias(f"{s.lower()}_{c}") for s in ("A", "B") for c in SIDE_COLUMNS],
        pick("A", "model_id").alias("agent_a"),
        pick("B", "model_id").alias("agent_b"),
    )
    when_ok = lambda c: F.when(F.col("eligible"), c)
    diff = lambda c: when_ok(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")))
    return wide.withColumns(
        {
            "residual_gap_difference": diff("corrected_gap"),
            "raw_gap_difference": diff("raw_gap"),
            "precision_difference": diff("precision"),
            "prior_difference": diff("pi_target"),
            "abs_gap_a": when_ok(F.abs("a_corrected_gap")),
            "abs_gap_b": when_ok(F.abs("b_corrected_gap")),
        }
    )


def occurrence_stats(rows: DataFrame, by: Sequence[str], gap: str = "corrected_gap") -> DataFrame:
    g = F.col(gap)
    n = F.count(g)
    pos, neg = F.count_if(g > 0), F.count_if(g < 0)
    return rows.where(g.isNotNull()).groupBy(*by).agg(
        n.alias("occurrences"),
        F.median(g).alias("median_gap"),
        F.median(F.abs(g)).alias("median_abs_gap"),
        F.min(g).alias("min_gap"),
        F.max(g).alias("max_gap"),
        stats.ratio(pos, n).alias("positive_fraction"),
        stats.ratio(neg, n).alias("negative_fraction"),
        (n - pos - neg).alias("zero_count"),
        stats.ratio(F.greatest(pos, neg), n).alias("same_sign_fraction"),
    )


def persistence_table(long: DataFrame, min_occurrences: int = 7) -> DataFrame:
    """Does a (model, head) cell keep a large gap of one sign over its folds?"""
    used = F.col("eligible") & ~F.col("degenerate")
    g = F.when(used, F.col("corrected_gap"))
    n = F.count(g)
    same = stats.ratio(F.greatest(F.count_if(g > 0), F.count_if(g < 0)), n)
    required = F.when(n >= 9, F.lit(7 / 9)).when(n > 0, F.lit(0.80))
    persistent = (
        (n >= min_occurrences)
        & (F.median(F.abs(g)) >= fixed.ROBUST_GAP)
        & (same >= required - fixed.SIGN_EPS)
    )
    return long.groupBy("model_id", "head").agg(
        F.count(F.lit(1)).alias("folds_in_scope"),
        n.alias("occurrences"),
        F.count_if(~F.col("eligible")).alias("excluded_small"),
        F.count_if(F.col("eligible") & F.col("degenerate")).alias("excluded_degenerate"),
        F.median(g).alias("median_gap"),
        F.median(F.abs(g)).alias("median_abs_gap"),
        stats.ratio(F.count_if(g > 0), n).alias("positive_fraction"),
        stats.ratio(F.count_if(g < 0), n).alias("negative_fraction"),
        (n - F.count_if(g > 0) - F.count_if(g < 0)).alias("zero_count"),
        same.alias("same_sign_fraction"),
        required.alias("same_sign_required"),
        F.coalesce(persistent, F.lit(False)).alias("persistent"),
    )


def agent_prior_summary(long: DataFrame) -> DataFrame:
    return (
        long.where(F.col("head") == "success")
        .groupBy("model_id")
        .agg(
            F.count("pi_target").alias("folds"),
            F.avg("pi_target").alias("mean_prior"),
            F.min("pi_target").alias("min_prior"),
            F.max("pi_target").alias("max_prior"),
            F.bool_or(F.col("pi_target").isin(0.0, 1.0)).alias("degenerate_in_any"),
        )
    )


def gap_ranking(long: DataFrame) -> DataFrame:
    """Models ordered by median |gap| within each head, cross-checked with the persistence table."""
    used = long.where(F.col("eligible") & ~F.col("degenerate"))
    own = used.groupBy("head", "model_id").agg(
        F.count(F.lit(1)).alias("occurrences"), F.median(F.abs("corrected_gap")).alias("median_abs_gap")
    )
    cells = long.select("head", "model_id").distinct().join(own, ["head", "model_id"], "left")
    order = Window.partitionBy("head").orderBy(F.desc_nulls_last("median_abs_gap"), "model_id")
    ranked = cells.withColumn("position", F.row_number().over(order))
    check = persistence_table(long).select(
        "head", "model_id", F.col("median_abs_gap").alias("table_value")
    )
    return ranked.join(check, ["head", "model_id"]).select(
        "head",
        "model_id",
        F.coalesce("occurrences", F.lit(0)).alias("occurrences"),
        "median_abs_gap",
        "position",
        F.abs(F.col("median_abs_gap") - F.col("table_value")).alias("difference"),
    )


def secondary_correlations(pairwise: DataFrame) -> DataFrame:
    used = pairwise.where("eligible")
    rho_res = stats.spearman(used, ["head"], "prior_difference", "residual_gap_difference", "rho_residual")
    rho_raw = stats.spearman(used, ["head"], "prior_difference", "raw_gap_difference", "rho_raw")
    base = used.groupBy("head").agg(
        F.count(F.lit(1)).alias("eligible_folds"),
        F.median("raw_gap_difference").alias("median_raw"),
        F.median("residual_gap_difference").alias("median_residual"),
        F.count_if(F.col("residual_gap_difference") < F.col("raw_gap_difference")).alias("folds_reduced"),
        F.median("precision_difference").alias("median_precision_difference"),
        F.max("precision_difference").alias("max_precision_difference"),
    )
    return base.join(rho_res, "head", "left").join(rho_raw, "head", "left")


def jackknife(rows: DataFrame, by: Sequence[str], gap: str = "corrected_gap") -> DataFrame:
    """Median of the remaining folds for every fold left out.

    A target has at most one occurrence per partner model, so its occurrences fit one small array
    and each left-out median is computed inside the row.
    """
    item = F.struct(F.col(gap).alias("g"), F.col("pair_id").alias("p"))
    grouped = rows.where(F.col(gap).isNotNull()).groupBy(*by).agg(
        F.collect_list(item).alias("all"), F.median(gap).alias("full_median")
    )
    left = grouped.select(*by, "all", "full_median", F.explode(F.transform("all", lambda x: x["p"])).alias("left_out"))
    others = F.filter("all", lambda x: x["p"] != F.col("left_out"))
    left = left.withColumns(
        {
            "signed": F.array_sort(F.transform(others, lambda x: x["g"])),
            "size": F.array_sort(F.transform(others, lambda x: F.abs(x["g"]))),
        }
    )
    return left.select(
        *by,
        "left_out",
        _array_median("signed").alias("median_gap"),
        _array_median("size").alias("median_abs_gap"),
        (F.signum(_array_median("signed")) == F.signum("full_median")).alias("sign_preserved"),
    )


def _array_median(name: str) -> Column:
    n = F.size(name)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(name, low) + F.get(name, high)) / 2)


def jackknife_summary(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return jackknife(rows, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("folds"),
        F.min("median_gap").alias("min_median"),
        F.max("median_gap").alias("max_median"),
        F.min(F.abs("median_gap")).alias("min_abs_median"),
        F.bool_and("sign_preserved").alias("sign_preserved_all"),
    )


def task_half(instance) -> Column:
    """Half A or B of the tasks by the lowest bit of the SHA-256 of the name."""
    digit = F.conv(F.right(F.sha2(F.col(instance), 256), F.lit(1)), 16, 10).cast("int")
    return F.when(digit % 2 == 0, "A").otherwise("B")


def target_occurrences(long: DataFrame, targets: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Occurrences of a few declared (scope, model, head) targets."""
    scope = F.lit(None).cast("string")
    for name, model, head in targets:
        scope = F.when((F.col("model_id") == model) & (F.col("head") == head), F.lit(name)).otherwise(scope)
    return long.withColumn("scope", scope).where(F.col("scope").isNotNull())


def universe(long: DataFrame, targets: Sequence[tuple[str, str, str]]) -> DataFrame:
    """The frozen occurrence set: both sides eligible and the prior not degenerate."""
    rows = target_occurrences(long, targets)
    return rows.where(F.col("eligible") & ~F.col("degenerate")).select("scope", "pair_id")


def universe_audit(long: DataFrame, targets: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Frozen universe against the literal rule that looks at the target side only."""
    rows = target_occurrences(long, targets)
    frozen = F.col("eligible") & ~F.col("degenerate")
    literal = (F.col("decisions") >= fixed.MIN_DECISIONS) & ~F.col("degenerate")
    g = F.col("corrected_gap")
    return rows.groupBy("scope").agg(
        F.count_if(frozen).alias("frozen_occurrences"),
        F.count_if(literal).alias("literal_occurrences"),
        F.count_if(literal & ~frozen).alias("extra_occurrences"),
        F.median(F.when(frozen, g)).alias("frozen_median"),
        F.median(F.when(literal, g)).alias("literal_median"),
    )
