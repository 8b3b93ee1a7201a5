"""Labels, provider families, identity across corpora, and second-corpus target metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise import fixed
from stopwise.functions import stats


def _contains_any(text: Column, parts: Sequence[str]) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | text.contains(part)
    return hit


def provider_family(label: str | Column) -> Column:
    text = F.lower(F.col(label) if isinstance(label, str) else label)
    out = F
    for name, parts in fixed.PROVIDER_FAMILIES:
        out = out.when(_contains_any(text, parts), name)
    return out.otherwise(fixed.PROVIDER_OTHER)


def split_label(label: str) -> tuple[Column, Column]:
    """(slug, provider) of 'slug@provider', split at the last @."""
    c = F.col(label)
    has = c.contains("@")
    provider = F.when(has, F.substring_index(c, "@", -1))
    slug = F.when(has, F.regexp_extract(c, r"^(.*)@[^@]*$", 1)).otherwise(c)
    return slug, provider


def split_canonical(name: str) -> tuple[Column, Column]:
    """(slug, provider) of 'provider/slug', split at the first slash."""
    c = F.col(name)
    has = c.contains("/")
    provider = F.when(has, F.substring_index(c, "/", 1))
    slug = F.when(has, F.regexp_extract(c, r"^[^/]*/(.*)$", 1)).otherwise(c)
    return slug, provider


def identity_evidence(rows: DataFrame, label: str = "model", canonical: str = "canonical_name") -> DataFrame:
    """Same exact model on both sides? Only literal names count, up to letter case.

    Names are counted per (label, name) first, so a label with very many rows is combined early.
    """
    counts = rows.groupBy(label, canonical).agg(F.count(F.lit(1)).alias("n"))
    per_label = counts.groupBy(label).agg(
        F.count(F.lit(1)).alias("distinct_names"), F.sum("n").alias("rows"), F.min(canonical).alias("name")
    )
    ls, lp = split_label(label)
    cs, cp = split_canonical("name")
    same_slug = F.lower(ls).eqNullSafe(F.lower(cs))
    same_provider = F.lower(lp).eqNullSafe(F.lower(cp))
    state = (
        F.when(F.col("distinct_names") != 1, "AMBIGUOUS")
        .when(same_slug & same_provider, "CONFIRMED")
        .when(same_slug | same_provider, "AMBIGUOUS")
        .otherwise("MISMATCH")
    )
    return per_label.withColumn("identity", state)


def target_metrics(gaps: DataFrame, boot: DataFrame, keys: Sequence[str], label: Column) -> DataFrame:
    """Gap, interval, robust flag and family of each target."""
    joined = gaps.join(boot.select(*keys, "n_valid", "ci_lower", "ci_median", "ci_upper"), list(keys), "left")
    big = (F.col("decisions") >= fixed.MIN_DECISIONS) & ~F.col("degenerate")
    return joined.withColumns(
        {
            "robust": big & stats.robust("corrected_gap", "ci_lower", "ci_upper"),
            "family": provider_family(label),
        }
    )


def provider_concentration(models: DataFrame) -> DataFrame:
    """Qualifying models per provider family."""
    return models.groupBy("family").agg(F.count_distinct("model_id").alias("models"))


def pooled_point(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Occurrences pooled by their decisions; correct counts are restored from the precision."""
    n = F.col("decisions")
    correct = F.rint(F.col("precision") * n)
    return rows.where(n > 0).groupBy(*by).agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.sum(n).alias("decisions"),
        F.min(n).alias("decisions_min"),
        F.max(n).alias("decisions_max"),
        F.median(n).alias("decisions_median"),
        stats.ratio(F.sum(correct), F.sum(n)).alias("precision_pooled"),
        F.median("precision").alias("precision_median"),
        stats.ratio(F.sum(F.col("corrected_mean") * n), F.sum(n)).alias("corrected_pooled"),
        F.median("corrected_mean").alias("corrected_median"),
        F.median("corrected_gap").alias("median_gap"),
    )


def cross_corpus_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both corpora below each other in one schema."""
    return first.withColumn("corpus", F.lit("first")).unionByName(second.withColumn("corpus", F.lit("second")))


def robust_comparison(metrics: DataFrame) -> DataFrame:
    """Median and largest |gap| over all targets and over the robust ones."""
    a = F.abs("corrected_gap")
    return metrics.where(F.col("decisions") > 0).agg(
        F.count(F.lit(1)).alias("targets"),
        F.count_if("robust").alias("robust_targets"),
        F.count_distinct(F.when(F.col("robust"), F.col("model_id"))).alias("robust_models"),
        F.median(a).alias("median_abs_gap"),
        F.max(a).alias("max_abs_gap"),
        F.median(F.when(F.col("robust"), a)).alias("median_abs_gap_robust"),
        F.max(F.when(F.col("robust"), a)).alias("max_abs_gap_robust"),
    )


def head_descriptive(metrics: DataFrame) -> DataFrame:
    """Range of the corrected gap and its rank correlation with both priors, eligible targets only."""
    used = metrics.where(~F.col("degenerate") & (F.col("decisions") >= fixed.MIN_DECISIONS))
    base = used.groupBy("head").agg(
        F.count(F.lit(1)).alias("eligible_targets"),
        (F.max("corrected_gap") - F.min("corrected_gap")).alias("gap_range"),
        F.min("corrected_gap").alias("min_gap"),
        F.max("corrected_gap").alias("max_gap"),
    )
    test = stats.spearman(used, ["head"], "test_prior", "corrected_gap", "rho_test").drop("n_rho_test")
    train = stats.spearman(used, ["head"], "train_prior", "corrected_gap", "rho_train").drop("n_rho_train")
    return base.join(test, "head", "left").join(train, "head", "left")
