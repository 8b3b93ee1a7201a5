"""Rule gates: criteria with value, requirement and verdict, and one outcome label.

A gate works on facts, (name, value) rows taken from result tables that are already small; a gate
never touches raw rows itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise import fixed
from stopwise.functions import stats


def facts(df: DataFrame, names: Sequence[str], values: Sequence[str], by: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """Long (name, value) rows; the name joins the key columns and the value column with dots."""
    key = [F.col(c) for c in names]
    items = [
        F.struct(
            F.concat_ws(".", *([F.lit(prefix)] if prefix else []), *key, F.lit(v)).alias("fact"),
            F.col(v).cast("double").alias("value"),
        )
        for v in values
    ]
    return df.select(*by, F.inline(F.array(*items)))


def one_row(frames: Sequence[DataFrame], wanted: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Facts as columns, one row per scope; a missing fact is NULL."""
    every = reduce(DataFrame.unionByName, frames)
    pick = lambda f: F.max(F.when(F.col("fact") == f, F.col("value"))).alias(f.replace(".", "__"))
    return every.groupBy(*by).agg(*[pick(f) for f in wanted])


def gate(
    wide: DataFrame,
    checks: Sequence[tuple[str, Column, float | None, Column]],
    label,
    by: Sequence[str] = (),
) -> DataFrame:
    """Criteria rows and one RESULT row per scope. ``label`` maps the verdict columns to an outcome."""
    ok = {name: F.coalesce(passed, F.lit(False)) for name, _, _, passed in checks}
    rows = [
        F.struct(
            F.lit(name).alias("criterion"),
            value.cast("double").alias("value"),
            F.lit(required).cast("double").alias("required"),
            ok[name].alias("passed"),
            F.lit(None).cast("string").alias("label"),
        )
        for name, value, required, _ in checks
    ]
    rows.append(
        F.struct(
            F.lit("RESULT").alias("criterion"),
            F.lit(None).cast("double").alias("value"),
            F.lit(None).cast("double").alias("required"),
            F.lit(None).cast("boolean").alias("passed"),
            label(ok).alias("label"),
        )
    )
    return wide.select(*by, F.inline(F.array(*rows)))


def _all(ok: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a & b, ok.values())


def _count(ok: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [c.cast("int") for c in ok])


def at_least(name: str, value, required: float):
    c = F.col(value) if isinstance(value, str) else value
    return (name, c, required, c >= required)


def above(name: str, value, required: float):
    c = F.col(value) if isinstance(value, str) else value
    return (name, c, required, c > required)


def error_signal_gate(outcome: DataFrame) -> DataFrame:
    """Enough errors, of one direction, over several models, with the matching late signature."""
    one = lambda cls: F.count_if(F.col("outcome_class") == cls)
    per_model = outcome.groupBy("model_id").agg(
        one("FALSE_FAILURE").alias("ff"),
        one("FALSE_SUCCESS").alias("fs"),
        F.count_if((F.col("outcome_class") == "FALSE_FAILURE") & F.col("ff_signature")).alias("ff_sig"),
        F.count_if((F.col("outcome_class") == "FALSE_SUCCESS") & F.col("fs_signature")).alias("fs_sig"),
    )
    sums = per_model.agg(
        *[
            agg
            for d in ("ff", "fs")
            for agg in (
                F.sum(d).alias(d),
                F.max(d).alias(f"{d}_max"),
                F.count_if(F.col(d) > 0).alias(f"{d}_models"),
                F.sum(f"{d}_sig").alias(f"{d}_sig"),
            )
        ]
    )
    dominant = F.col("ff") >= F.col("fs")
    of = lambda suffix: F.when(dominant, F.col("ff" + suffix)).otherwise(F.col("fs" + suffix))
    wide = sums.select(
        (F.col("ff") + F.col("fs")).alias("errors"),
        stats.ratio(of(""), F.col("ff") + F.col("fs")).alias("share"),
        of("_models").alias("models"),
        stats.ratio(of("_max"), of("")).alias("largest"),
        stats.ratio(of("_sig"), of("")).alias("signature_rate"),
    )
    checks = [
        at_least("A_errors", "errors", fixed.ERRORS_MIN),
        at_least("B_dominant_share", "share", fixed.DOMINANT_SHARE),
        at_least("C_models_with_error", "models", fixed.MODELS_WITH_ERROR_MIN),
        ("D_largest_model_share", F.col("largest"), fixed.LARGEST_MODEL_SHARE, F.col("largest") <= fixed.LARGEST_MODEL_SHARE),
        at_least("E_signature_rate", "signature_rate", fixed.SIGNATURE_RATE),
    ]
    return gate(wide, checks, lambda ok: F.when(_all(ok), "GO_CANDIDATE").otherwise("NO_STRONG_SIGNAL"))


def signature_gate(block: DataFrame, boot: DataFrame) -> DataFrame:
    """Are the late-reversal signatures enriched among errors once standardised?"""
    wanted = [
        f"{d}.{v}" for d in ("FALSE_SUCCESS", "FALSE_FAILURE") for v in ("std_risk_difference", "n_error", "models_with_error")
    ] + ["fs_risk_difference_std.ci_lower", "ff_risk_difference_std.ci_lower"]
    wide = one_row(
        [
            facts(block, ["direction"], ["std_risk_difference", "n_error", "models_with_error"]),
            facts(boot, ["statistic"], ["ci_lower"]),
        ],
        wanted,
    )
    checks = []
    for tag, d, low in (
        ("FS", "FALSE_SUCCESS", "fs_risk_difference_std__ci_lower"),
        ("FF", "FALSE_FAILURE", "ff_risk_difference_std__ci_lower"),
    ):
        rd, lo = F.col(f"{d}__std_risk_difference"), F.col(low)
        strong = (
            (rd >= fixed.ONE_DIRECTION_DIFFERENCE)
            & (lo > 0)
            & (F.col(f"{d}__n_error") >= fixed.ONE_DIRECTION_ERRORS)
            & (F.col(f"{d}__models_with_error") >= fixed.MODELS_WITH_ERROR_MIN)
        )
        checks += [
            (f"{tag}_enriched", rd, fixed.ENRICHED_DIFFERENCE, (rd >= fixed.ENRICHED_DIFFERENCE) & (lo > 0)),
            (f"{tag}_one_direction", rd, fixed.ONE_DIRECTION_DIFFERENCE, strong),
        ]
    label = lambda ok: (
        F.when(ok["FS_enriched"] & ok["FF_enriched"], "ROBUST_BIDIRECTIONAL_SIGNAL")
        .when(ok["FS_one_direction"] | ok["FF_one_direction"], "ROBUST_ONE_DIRECTION_SIGNAL")
        .otherwise("SIGNAL_NOT_YET_ROBUST")
    )
    return gate(wide, checks, label)


def transfer_gate(
    spread: DataFrame, boot: DataFrame, rho: DataFrame, rho_excluding: DataFrame, calibration: DataFrame
) -> DataFrame:
    """Heterogeneity, prior shift and calibration transfer; two of three carry."""
    large = (
        calibration.where((F.col("model_id") != "__POOLED__") & F.col("enough") & F.col("large"))
        .agg(F.count_distinct("model_id").alias("large_models"))
    )
    errors = lambda df: df.where(F.col("measure") == "error_rate")
    wide = one_row(
        [
            facts(spread, ["head"], ["value_range"]),
            facts(boot, ["statistic"], ["ci_lower"]),
            facts(errors(rho), ["head"], ["rho"], prefix="all"),
            facts(errors(rho_excluding), ["head"], ["rho"], prefix="excluding"),
            facts(large, [], ["large_models"]),
        ],
        [
            "success.value_range",
            "failure.value_range",
            "success_precision_range.ci_lower",
            "failure_precision_range.ci_lower",
            "all.success.rho",
            "all.failure.rho",
            "excluding.success.rho",
            "excluding.failure.rho",
            "large_models",
        ],
    )
    spread_ok = lambda h: (F.col(f"{h}__value_range") >= fixed.HETEROGENEITY_RANGE) & (
        F.col(f"{h}_precision_range__ci_lower") > fixed.HETEROGENEITY_CI
    )
    rs, rf = F.col("all__success__rho"), F.col("all__failure__rho")
    checks = [
        ("heterogeneity_success", F.col("success__value_range"), fixed.HETEROGENEITY_RANGE, spread_ok("success")),
        ("heterogeneity_failure", F.col("failure__value_range"), fixed.HETEROGENEITY_RANGE, spread_ok("failure")),
        ("prior_shift_success", rs, -fixed.STRONG_RHO, (rs <= -fixed.STRONG_RHO) & (F.col("excluding__success__rho") < 0)),
        ("prior_shift_failure", rf, fixed.STRONG_RHO, (rf >= fixed.STRONG_RHO) & (F.col("excluding__failure__rho") > 0)),
        at_least("calibration_transfer", "large_models", fixed.LARGE_GAP_MODELS),
    ]

    def label(ok):
        signals = [
            ok["heterogeneity_success"] | ok["heterogeneity_failure"],
            ok["prior_shift_success"] | ok["prior_shift_failure"],
            ok["calibration_transfer"],
        ]
        return F.when(_count(signals) >= 2, "GO_CANDIDATE").otherwise("NO_STRONG_SIGNAL")

    return gate(wide, checks, label)


def residual_gate(gaps: DataFrame, ranges: DataFrame, boot: DataFrame) -> DataFrame:
    """What remains after the prior correction: large gaps and their spread."""
    large = gaps.where(
        ~F.col("degenerate")
        & (F.col("decisions") >= fixed.MIN_DECISIONS)
        & (F.abs("corrected_gap") >= fixed.LARGE_GAP)
    ).agg(F.count_distinct("model_id").alias("large_models"))
    wide = one_row(
        [
            facts(large, [], ["large_models"]),
            facts(ranges, ["head"], ["residual_range"]),
            facts(boot.where(F.col("statistic") == "residual_gap_range"), ["head"], ["ci_lower"]),
        ],
        ["large_models"] + [f"{h}.{v}" for h in fixed.HEADS for v in ("residual_range", "ci_lower")],
    )
    checks = [at_least("residual_large_gap_models", "large_models", fixed.LARGE_GAP_MODELS)]
    for h in fixed.HEADS:
        r = F.col(f"{h}__residual_range")
        checks.append(
            (f"substantial_{h}", r, fixed.RESIDUAL_RANGE, (r >= fixed.RESIDUAL_RANGE) & (F.col(f"{h}__ci_lower") > fixed.RESIDUAL_CI))
        )

    def label(ok):
        substantial = ok["substantial_success"] | ok["substantial_failure"]
        return (
            F.when(ok["residual_large_gap_models"] & substantial, "GO")
            .when((F.col("large_models") <= 1) & ~substantial, "PIVOT_TO_PRIOR_SHIFT_ADAPTATION")
            .otherwise("PARTIAL_RESIDUAL_MISCALIBRATION")
        )

    return gate(wide, checks, label)


def same_predictor_gate(scopes: dict[str, tuple[DataFrame, DataFrame, DataFrame]]) -> DataFrame:
    """Per declared scope: heterogeneity of pair folds, and persistence of single models.

    Each scope brings its pairwise table, its bootstrap and its persistence table; an excluded
    label is a further scope, it never replaces the primary one.
    """
    frames = []
    for scope, (pairwise, boot, persistence) in scopes.items():
        tag = F.lit(scope).alias("scope")
        points = (
            pairwise.where("eligible")
            .groupBy("head")
            .agg(F.count(F.lit(1)).alias("folds"), F.median("residual_gap_difference").alias("median"))
        )
        agents = persistence.agg(
            F.count_distinct(F.when(F.col("persistent"), F.col("model_id"))).alias("persistent_agents")
        )
        frames += [
            facts(points.select("*", tag), ["head"], ["folds", "median"], ["scope"]),
            facts(boot.select("*", tag), ["head"], ["ci_lower"], ["scope"]),
            facts(agents.select("*", tag), [], ["persistent_agents"], ["scope"]),
        ]
    wide = one_row(
        frames,
        [f"{h}.{v}" for h in fixed.HEADS for v in ("folds", "median", "ci_lower")] + ["persistent_agents"],
        ["scope"],
    )
    checks = []
    for h in fixed.HEADS:
        checks += [
            at_least(f"{h}_folds", F.coalesce(f"{h}__folds", F.lit(0.0)), fixed.PAIR_FOLDS_MIN),
            at_least(f"{h}_median", f"{h}__median", fixed.PAIR_MEDIAN_MIN),
            above(f"{h}_ci_lower", f"{h}__ci_lower", fixed.PAIR_CI_MIN),
        ]
    checks.append(at_least("persistent_agents", "persistent_agents", fixed.PERSISTENT_AGENTS_MIN))

    def label(ok):
        head = lambda h: ok[f"{h}_folds"] & ok[f"{h}_median"] & ok[f"{h}_ci_lower"]
        same, persistent = head("success") | head("failure"), ok["persistent_agents"]
        return F.when(same & persistent, "STRONG_PASS").when(same | persistent, "PARTIAL_PASS").otherwise("NO_PASS")

    return gate(wide, checks, label, ["scope"])


def _keeps_sign(base: Column, lo: Column, hi: Column) -> Column:
    outside = (lo > 0) | (hi < 0)
    return outside & (F.signum(lo) == F.signum(base)) & (F.signum(hi) == F.signum(base))


def target_gate(stats_rows: DataFrame, boot: DataFrame, jack: DataFrame, halves: DataFrame) -> DataFrame:
    """Eight criteria per target; every one must hold."""
    half = halves.where("counted").groupBy("scope", "half").agg(
        F.count(F.lit(1)).alias("folds"), F.median("corrected_gap").alias("median")
    )
    wide = one_row(
        [
            facts(stats_rows, [], ["occurrences", "median_gap", "median_abs_gap", "same_sign_fraction"], ["scope"]),
            facts(boot, [], ["ci_lower", "ci_upper"], ["scope"]),
            facts(jack.withColumn("sign_kept", F.col("sign_preserved_all").cast("int")), [], ["sign_kept", "min_abs_median"], ["scope"]),
            facts(half, ["half"], ["folds", "median"], ["scope"]),
        ],
        ["occurrences", "median_gap", "median_abs_gap", "same_sign_fraction", "ci_lower", "ci_upper", "sign_kept", "min_abs_median"]
        + [f"{h}.{v}" for h in "AB" for v in ("folds", "median")],
        ["scope"],
    )
    base = F.col("median_gap")
    checks = [
        at_least("A_occurrences", "occurrences", fixed.TARGET_OCCURRENCES_MIN),
        at_least("B_median_abs_gap", "median_abs_gap", fixed.TARGET_GAP_MIN),
        at_least("C_same_sign", "same_sign_fraction", fixed.TARGET_SAME_SIGN_MIN),
        ("D_interval_keeps_sign", F.col("ci_lower"), None, _keeps_sign(base, F.col("ci_lower"), F.col("ci_upper"))),
        at_least("E_jackknife_sign", "sign_kept", 1.0),
        at_least("F_jackknife_gap", "min_abs_median", fixed.JACKKNIFE_GAP_MIN),
    ]
    for tag, h in (("G", "A"), ("H", "B")):
        m = F.col(f"{h}__median")
        ok = (F.col(f"{h}__folds") >= fixed.HALF_FOLDS_MIN) & (F.signum(m) == F.signum(base)) & (F.abs(m) >= fixed.HALF_GAP_MIN)
        checks.append((f"{tag}_half_{h}", m, fixed.HALF_GAP_MIN, ok))
    return gate(wide, checks, lambda ok: F.when(_all(ok), "TARGET_ROBUST").otherwise("NOT_ROBUST"), ["scope"])


def overall_targets(gates: DataFrame, passed: str, labels: tuple[str, str, str]) -> DataFrame:
    """Outcome over all targets: every one, at least one, or none."""
    verdict = gates.where(F.col("criterion") == "RESULT").agg(
        F.count(F.lit(1)).alias("targets"), F.count_if(F.col("label") == passed).alias("robust")
    )
    every, some, none = labels
    return verdict.withColumn(
        "label", F.when(F.col("robust") == F.col("targets"), every).when(F.col("robust") > 0, some).otherwise(none)
    )


def threshold_points(rows: DataFrame, boot: DataFrame, baseline: DataFrame) -> DataFrame:
    """Criteria of every target and threshold, the sign being that of the primary threshold."""
    wide = (
        rows.join(boot.select("scope", "threshold", "ci_lower", "ci_upper"), ["scope", "threshold"], "left")
        .join(baseline.select("scope", F.col("median_gap").alias("base")), "scope", "left")
    )
    checks = [
        at_least("A_occurrences", "occurrences", fixed.TARGET_OCCURRENCES_MIN),
        at_least("B_median_abs_gap", "median_abs_gap", fixed.THRESHOLD_GAP_MIN),
        at_least("C_same_sign", "same_sign_fraction", fixed.THRESHOLD_SAME_SIGN_MIN),
        ("D_interval_keeps_sign", F.col("ci_lower"), None, _keeps_sign(F.col("base"), F.col("ci_lower"), F.col("ci_upper"))),
    ]
    return gate(wide, checks, lambda ok: F.when(_all(ok), "ROBUST").otherwise("NOT_ROBUST"), ["scope", "threshold"])


def threshold_gate(points: DataFrame) -> DataFrame:
    """A target is robust when enough thresholds pass and the primary one is among them."""
    ok = F.col("label") == "ROBUST"
    wide = points.where(F.col("criterion") == "RESULT").groupBy("scope").agg(
        F.count_if(ok).alias("passed_thresholds"),
        F.coalesce(F.bool_or(ok & (F.col("threshold") == fixed.PRIMARY_THRESHOLD)), F.lit(False)).cast("int").alias("primary"),
    )
    checks = [
        at_least("thresholds_passed", "passed_thresholds", fixed.THRESHOLDS_PASSED_MIN),
        at_least("primary_threshold", "primary", 1.0),
    ]
    return gate(wide, checks, lambda ok: F.when(_all(ok), "TARGET_THRESHOLD_ROBUST").otherwise("NOT_ROBUST"), ["scope"])


def robust_models(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Models with a robust large gap in some head, their family and their largest such gap."""
    return metrics.where("robust").groupBy(*by, "model_id", "family").agg(
        F.max(F.abs("corrected_gap")).alias("max_abs_gap"),
        F.array_join(F.array_sort(F.collect_set("head")), "|").alias("heads"),
        (F.max(F.abs("corrected_gap")) >= fixed.LARGE_GAP).alias("is_large"),
    )


def replication_gate(metrics: DataFrame) -> DataFrame:
    models = robust_models(metrics)
    wide = models.agg(
        F.count(F.lit(1)).alias("models"),
        F.count_if("is_large").alias("large"),
        F.count_distinct("family").alias("families"),
    )
    checks = [
        at_least("robust_models", "models", fixed.SIGNAL_MODELS_MIN),
        at_least("large_models", "large", fixed.SIGNAL_LARGE_MIN),
        above("families", "families", 1.0),
    ]
    label = lambda ok: F.when(_all(ok), "CROSS_BENCHMARK_SIGNAL").otherwise("NO_CROSS_BENCHMARK_SIGNAL")
    return gate(wide, checks, label)


def denominator_summary(metrics: DataFrame) -> DataFrame:
    """Eligible targets and their decisions per threshold and head."""
    used = ~F.col("degenerate") & (F.col("decisions") >= fixed.MIN_DECISIONS)
    d = F.when(used, F.col("decisions"))
    return metrics.groupBy("threshold", "head").agg(
        F.count(d).alias("eligible_targets"),
        F.coalesce(F.sum(d), F.lit(0)).alias("total_decisions"),
        F.median(d).alias("median_decisions"),
        F.min(d).alias("min_decisions"),
        F.max(d).alias("max_decisions"),
        F.count_if(used & F.col("robust")).alias("robust_targets"),
        (F.count(d) >= fixed.MIN_ADEQUATE_TARGETS).alias("adequate"),
    )


def denominator_gate(metrics: DataFrame) -> DataFrame:
    """The replication rule per threshold, with adequate heads: all of them, or any of them."""
    heads = denominator_summary(metrics).select("threshold", "head", "adequate")
    models = robust_models(metrics, ["threshold"])
    robust_heads = metrics.where("robust").select("threshold", "head").distinct().join(heads, ["threshold", "head"])
    adequacy = robust_heads.groupBy("threshold").agg(
        F.bool_and("adequate").alias("all_adequate"), F.bool_or("adequate").alias("any_adequate")
    )
    base = models.groupBy("threshold").agg(
        F.count(F.lit(1)).alias("models"),
        F.count_if("is_large").alias("large"),
        F.count_distinct("family").alias("families"),
    )
    wide = metrics.select("threshold").distinct().join(base, "threshold", "left").join(adequacy, "threshold", "left")
    wide = wide.fillna(0, ["models", "large", "families"]).fillna(False, ["all_adequate", "any_adequate"])
    rule = (
        (F.col("models") >= fixed.SIGNAL_MODELS_MIN)
        & (F.col("large") >= fixed.SIGNAL_LARGE_MIN)
        & (F.col("families") >= fixed.SIGNAL_FAMILIES_MIN)
    )
    return wide.withColumns(
        {
            "base_met": rule,
            "signal": rule & F.col("all_adequate"),
            "signal_any_head": rule & F.col("any_adequate"),
        }
    )


def denominator_result(per_threshold: DataFrame) -> DataFrame:
    name = lambda c: F.when(F.count_if(c) >= fixed.SIGNAL_THRESHOLDS_MIN, "DENOMINATOR_RESOLVED_SIGNAL").otherwise(
        "NO_CROSS_BENCHMARK_REPLICATION"
    )
    return per_threshold.agg(
        F.count_if("signal").alias("thresholds_with_signal"),
        F.count_if("signal_any_head").alias("thresholds_any_head"),
        name("signal").alias("result"),
        name("signal_any_head").alias("result_any_head"),
    )


def cross_corpus_status(rows: DataFrame) -> DataFrame:
    """Does a target's gap persist on the second corpus? The order of the rules matters."""
    gap, first = F.col("second_gap"), F.col("first_gap")
    zero = stats.ci_includes_zero("second_lower", "second_upper")
    same = stats.sign_name(gap) == stats.sign_name(first)
    status = (
        F.when(F.col("identity") != "CONFIRMED", "INDETERMINATE")
        .when(F.coalesce("second_decisions", F.lit(0)) < fixed.MIN_DECISIONS, "INDETERMINATE")
        .when(F.col("second_lower").isNull() | F.col("second_upper").isNull(), "INDETERMINATE")
        .when((F.abs(gap) >= fixed.ROBUST_GAP) & ~zero & same, "PERSISTENT")
        .when((F.abs(gap) < fixed.COLLAPSE_GAP) & zero, "COLLAPSED")
        .when(~same, "SIGN_CHANGED")
        .otherwise("UNCLASSIFIED")
    )
    return rows.withColumns({"ci_includes_zero": zero, "sign_matches": same, "status": status})


def cross_corpus_overall(status: DataFrame) -> DataFrame:
    qualified, persist, collapse = (
        F.count_if(F.col("identity") == "CONFIRMED"),
        F.count_if(F.col("status") == "PERSISTENT"),
        F.count_if(F.col("status") == "COLLAPSED"),
    )
    short = "INSUFFICIENT_CROSS_BENCHMARK_SUPPORT"
    return status.agg(
        qualified.alias("qualified"),
        persist.alias("persistent"),
        collapse.alias("collapsed"),
        F.when(F.count_if(F.col("identity") != "CONFIRMED") > 0, short)
        .when((persist == qualified) & (qualified > 0), "BOTH_PERSIST")
        .when(persist == 1, "ONE_PERSISTS")
        .when((collapse == qualified) & (qualified > 0), "BOTH_COLLAPSE")
        .otherwise(short)
        .alias("result"),
    )
