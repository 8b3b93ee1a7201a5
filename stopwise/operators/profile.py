"""Run-level summaries: classes, concentration, lengths, post-stop profiles, standardisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopwise import fixed
from stopwise.functions import stats

COMPONENTS = (
    "post_activity",
    "post_edit",
    "post_test",
    "post_test_pass",
    "post_test_fail",
    "post_error",
    "post_submission",
)


def directions() -> list[tuple[str, str, str]]:
    """(error class, control class, signature column)."""
    return [
        ("FALSE_SUCCESS", "CORRECT_SUCCESS", "fs_signature"),
        ("FALSE_FAILURE", "CORRECT_FAILURE", "ff_signature"),
    ]


def _n(*classes: str):
    return F.count_if(F.col("outcome_class").isin(*classes))


def confusion_metrics(outcome: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Error rate within each decision class, and share of each class among the errors."""
    cs, fs, cf, ff = (_n(c) for c in ("CORRECT_SUCCESS", "FALSE_SUCCESS", "CORRECT_FAILURE", "FALSE_FAILURE"))
    counts = outcome.groupBy(*by).agg(cs.alias("cs"), fs.alias("fs"), cf.alias("cf"), ff.alias("ff"))
    return confusion_rates(counts, by)


def confusion_rates(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    succ, fail, err = F.col("cs") + F.col("fs"), F.col("cf") + F.col("ff"), F.col("fs") + F.col("ff")
    return counts.select(
        *by,
        succ.alias("early_success"),
        fail.alias("early_failure"),
        F.col("fs").alias("false_success"),
        F.col("ff").alias("false_failure"),
        stats.ratio("fs", succ).alias("success_error_rate"),
        stats.ratio("ff", fail).alias("failure_error_rate"),
        stats.ratio("cs", succ).alias("success_precision"),
        stats.ratio("cf", fail).alias("failure_precision"),
        (stats.ratio("ff", fail) - stats.ratio("fs", succ)).alias("error_rate_difference"),
        err.alias("n_errors"),
        stats.ratio("fs", err).alias("false_success_share"),
        stats.ratio("ff", err).alias("false_failure_share"),
    )


def per_model_summary(outcome: DataFrame) -> DataFrame:
    correct = _n("CORRECT_SUCCESS", "CORRECT_FAILURE")
    decided = F.count_if("decided")
    resolved = F.sum("resolved")
    runs = F.count(F.lit(1))
    return outcome.groupBy("model_id").agg(
        runs.alias("runs"),
        resolved.alias("resolved"),
        F.avg("resolved").alias("resolve_rate"),
        decided.alias("early_decisions"),
        _n("CORRECT_SUCCESS").alias("correct_success"),
        _n("CORRECT_FAILURE").alias("correct_failure"),
        _n("FALSE_SUCCESS").alias("false_success"),
        _n("FALSE_FAILURE").alias("false_failure"),
        _n("NO_STOP").alias("no_stop"),
        stats.ratio(correct, decided).alias("decision_accuracy"),
        F.avg("decision_fraction").alias("mean_decision_fraction"),
        ((resolved == 0) | (resolved == runs)).alias("class_degenerate"),
    )


def error_summary(outcome: DataFrame) -> DataFrame:
    err = _n("FALSE_SUCCESS", "FALSE_FAILURE")
    runs = F.count(F.lit(1))
    return outcome.agg(
        runs.alias("runs"),
        F.count_if("decided").alias("early_decisions"),
        *[
            _n(c).alias(c.lower())
            for c in ("CORRECT_SUCCESS", "CORRECT_FAILURE", "FALSE_SUCCESS", "FALSE_FAILURE", "NO_STOP")
        ],
        err.alias("n_errors"),
        stats.ratio(_n("FALSE_FAILURE"), err).alias("false_failure_fraction"),
        stats.ratio(_n("FALSE_SUCCESS"), err).alias("false_success_fraction"),
        stats.ratio(F.count_if("decided"), runs).alias("coverage"),
    )


def concentration(outcome: DataFrame) -> DataFrame:
    """How concentrated is each error class in models and tasks; counts first, ranks after."""
    errors = outcome.where(F.col("outcome_class").isin("FALSE_SUCCESS", "FALSE_FAILURE"))
    cells = errors.groupBy("outcome_class", "model_id", "instance_id").agg(F.count(F.lit(1)).alias("n"))
    models = cells.groupBy("outcome_class", "model_id").agg(F.sum("n").alias("n"))
    tasks = cells.groupBy("outcome_class", "instance_id").agg(F.sum("n").alias("n"))

    # the smallest name among the largest counts, in one aggregate without ordering a class
    largest = lambda name: F.min_by(name, F.struct(-F.col("n"), name))
    by_model = models.groupBy("outcome_class").agg(
        F.sum("n").alias("errors"),
        F.count(F.lit(1)).alias("models_with_error"),
        largest("model_id").alias("largest_model"),
        stats.ratio(F.max("n"), F.sum("n")).alias("largest_model_share"),
    )
    by_task = tasks.groupBy("outcome_class").agg(
        F.count(F.lit(1)).alias("unique_tasks"),
        F.max("n").alias("max_runs_single_task"),
        largest("instance_id").alias("task_with_max_runs"),
    )
    return by_model.join(by_task, "outcome_class")


def concentration_top(outcome: DataFrame, models: int = 5, tasks: int = 10) -> DataFrame:
    """Top models and top tasks of each error class, ties to the smaller name."""
    errors = outcome.where(F.col("outcome_class").isin("FALSE_SUCCESS", "FALSE_FAILURE"))

    def top(name: str, k: int) -> DataFrame:
        counts = errors.groupBy("outcome_class", name).agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("outcome_class").orderBy(F.desc("n"), name)
        ranked = counts.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)
        return ranked.select("outcome_class", F.lit(name).alias("kind"), F.col(name).alias("name"), "n", "position")

    return top("model_id", models).unionByName(top("instance_id", tasks))


def decision_fraction_summary(outcome: DataFrame) -> DataFrame:
    """Decisions and errors per bin of the decision fraction; every bin is present."""
    one = lambda i: F.col("fraction_bin") == i
    err = F.col("outcome_class").isin("FALSE_SUCCESS", "FALSE_FAILURE")
    aggs = []
    for i, _ in enumerate(fixed.FRACTION_BINS):
        aggs += [
            F.count_if(one(i)).alias(f"d{i}"),
            F.count_if(one(i) & (F.col("outcome_class") == "FALSE_FAILURE")).alias(f"ff{i}"),
            F.count_if(one(i) & (F.col("outcome_class") == "FALSE_SUCCESS")).alias(f"fs{i}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(label).alias("bin"),
                F.col(f"d{i}").alias("decisions"),
                (F.col(f"ff{i}") + F.col(f"fs{i}")).alias("errors"),
                stats.ratio(F.col(f"ff{i}") + F.col(f"fs{i}"), f"d{i}").alias("error_rate"),
                F.col(f"ff{i}").alias("false_failure"),
                F.col(f"fs{i}").alias("false_success"),
            )
            for i, label in enumerate(fixed.FRACTION_BINS)
        ]
    )
    return outcome.where("decided").agg(*aggs).select(F.inline(rows))


def length_summary(outcome: DataFrame) -> DataFrame:
    step = F.when(F.col("decided"), F.col("decision_step"))
    return outcome.groupBy("outcome_class").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("n_steps_total").alias("length_mean"),
        F.median("n_steps_total").alias("length_median"),
        F.min("n_steps_total").alias("length_min"),
        F.max("n_steps_total").alias("length_max"),
        F.avg("saved_steps").alias("saved_mean"),
        F.median("saved_steps").alias("saved_median"),
        F.avg(step).alias("step_mean"),
        F.avg("decision_fraction").alias("fraction_mean"),
    )


def scope_summary(outcome: DataFrame) -> DataFrame:
    """Totals per model and overall, from one rollup."""
    return (
        outcome.rollup("model_id")
        .agg(
            F.count(F.lit(1)).alias("runs"),
            F.sum("n_prefix_rows").alias("prefix_rows"),
            F.avg("n_steps_total").alias("length_mean"),
            F.median("n_steps_total").alias("length_median"),
            F.min("n_steps_total").alias("length_min"),
            F.max("n_steps_total").alias("length_max"),
        )
        .withColumn("model_id", F.coalesce("model_id", F.lit("__ALL__")))
    )


def signature_summary(outcome: DataFrame) -> DataFrame:
    signature = F.when(F.col("outcome_class") == "FALSE_FAILURE", F.col("ff_signature")).otherwise(F.col("fs_signature"))
    return (
        outcome.where(F.col("outcome_class").isin("FALSE_SUCCESS", "FALSE_FAILURE"))
        .groupBy("outcome_class")
        .agg(
            F.count(F.lit(1)).alias("errors"),
            F.count_if(signature).alias("signature_count"),
            F.avg(signature.cast("double")).alias("signature_rate"),
            *[F.avg(F.col(c).cast("double")).alias(f"{c}_rate") for c in COMPONENTS],
            F.count_if(F.col("first_test_pass_after_stop") == "TRUE").alias("first_pass_true"),
        )
    )


def with_direction(outcome: DataFrame) -> DataFrame:
    """Decided rows tagged with their comparison: direction, error or control, signature."""
    cls = F.col("outcome_class")
    of_success = cls.isin("FALSE_SUCCESS", "CORRECT_SUCCESS")
    return outcome.where("decided").withColumns(
        {
            "direction": F.when(of_success, "FALSE_SUCCESS").otherwise("FALSE_FAILURE"),
            "is_error": cls.isin("FALSE_SUCCESS", "FALSE_FAILURE"),
            "signature": F.when(of_success, F.col("fs_signature")).otherwise(F.col("ff_signature")),
            # a run without a length has no fraction; the strata put it in the last bin
            "fraction_bin": F.coalesce("fraction_bin", F.lit(len(fixed.FRACTION_BINS) - 1)),
        }
    )


def post_stop_profile(outcome: DataFrame) -> DataFrame:
    """Component rates and tail lengths of error and control groups.

    The percentile aggregate keeps one counter per distinct tail length, which is bounded by the
    longest run, not by the number of runs.
    """
    q = F.percentile("post_steps", F.array(F.lit(0.25), F.lit(0.75)))
    return (
        with_direction(outcome)
        .groupBy("direction", "is_error")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.avg(F.col(c).cast("double")).alias(f"{c}_rate") for c in COMPONENTS],
            F.avg(F.col("signature").cast("double")).alias("signature_rate"),
            F.avg("post_steps").alias("steps_mean"),
            F.median("post_steps").alias("steps_median"),
            F.min("post_steps").alias("steps_min"),
            F.max("post_steps").alias("steps_max"),
            q[0].alias("steps_p25"),
            q[1].alias("steps_p75"),
            F.avg((F.col("post_steps") == 0).cast("double")).alias("zero_steps_rate"),
        )
    )


def strata_counts(outcome: DataFrame) -> DataFrame:
    """Error and control counts, with and without signature, per direction x model x bin."""
    hit = F.col("signature")
    return (
        with_direction(outcome)
        .groupBy("direction", "model_id", "fraction_bin")
        .agg(
            F.count_if("is_error").alias("ec"),
            F.count_if(~F.col("is_error")).alias("cc"),
            F.count_if(F.col("is_error") & hit).alias("ek"),
            F.count_if(~F.col("is_error") & hit).alias("ck"),
        )
    )


def strata_table(outcome: DataFrame, models: DataFrame) -> DataFrame:
    """The full direction x model x bin grid; strata without observations stay with NULL rates."""
    bins = F.explode(F.array(*[F.lit(i) for i in range(len(fixed.FRACTION_BINS))])).alias("fraction_bin")
    dirs = F.explode(F.array(*[F.lit(d[0]) for d in directions()])).alias("direction")
    spine = models.select("model_id", dirs).select("model_id", "direction", bins)
    full = spine.join(strata_counts(outcome), ["direction", "model_id", "fraction_bin"], "left")
    full = full.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("ec", "cc", "ek", "ck")})
    return full.withColumns(
        {
            "bin": stats.bin_label("fraction_bin"),
            "rate_error": stats.ratio("ek", "ec"),
            "rate_control": stats.ratio("ck", "cc"),
            "risk_difference": stats.ratio("ek", "ec") - stats.ratio("ck", "cc"),
            "usable": (F.col("ec") > 0) & (F.col("cc") > 0),
        }
    )


def standardize(strata: DataFrame, by: Sequence[str]) -> DataFrame:
    """Direct standardisation on common support.

    Strata holding errors and controls are weighted by their share of the errors; the weight they
    cover is reported beside the two rates.
    """
    usable = (F.col("ec") > 0) & (F.col("cc") > 0)
    weight = F.when(usable, F.col("ec").cast("double"))
    pe, pc = stats.ratio("ek", "ec"), stats.ratio("ck", "cc")
    support = F.sum(weight)
    return strata.groupBy(*by).agg(
        F.sum("ec").alias("n_error"),
        F.sum("cc").alias("n_control"),
        stats.ratio(F.sum("ek"), F.sum("ec")).alias("raw_error_rate"),
        stats.ratio(F.sum("ck"), F.sum("cc")).alias("raw_control_rate"),
        F.try_divide(F.sum(weight * pe), support).alias("std_error_rate"),
        F.try_divide(F.sum(weight * pc), support).alias("std_control_rate"),
        F.try_divide(F.sum(weight * (pe - pc)), support).alias("std_risk_difference"),
        F.coalesce(stats.ratio(support, F.sum("ec")), F.lit(0.0)).alias("covered_weight"),
        F.count_if(usable).alias("strata_used"),
        F.count_if(F.col("ec") > 0).alias("strata_with_error"),
        F.coalesce(support, F.lit(0.0)).alias("n_in_support"),
    )


def signature_block(strata: DataFrame) -> DataFrame:
    """Raw, standardised and composite risk differences per direction."""
    models = strata.where(F.col("ec") > 0).groupBy("direction").agg(F.count_distinct("model_id").alias("models_with_error"))
    return (
        standardize(strata, ["direction"])
        .join(models, "direction", "left")
        .withColumns(
            {
                "models_with_error": F.coalesce("models_with_error", F.lit(0)),
                "raw_risk_difference": F.col("raw_error_rate") - F.col("raw_control_rate"),
                "composite_risk_difference": F.col("raw_error_rate") - F.col("std_control_rate"),
            }
        )
    )
