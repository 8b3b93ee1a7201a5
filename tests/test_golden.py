"""Published aggregates, recomputed from their published inputs."""

import math

import pytest
from pyspark.sql import functions as F

from stopwise.functions import stats
from stopwise.operators import corpora, pairs


def one(spark, **exprs):
    return spark.range(1).select(*[c.alias(n) for n, c in exprs.items()]).first()


def test_wilson_bounds(spark):
    low, high = stats.wilson(F.lit(275), F.lit(300))
    row = one(spark, p=stats.ratio(F.lit(275), F.lit(300)), low=low, high=high)
    assert row.p == pytest.approx(0.916667, abs=1e-6)
    assert row.low == pytest.approx(0.879878, abs=1e-6)
    assert row.high == pytest.approx(0.942919, abs=1e-6)


def test_wilson_empty_and_edges(spark):
    low, high = stats.wilson(F.lit(0), F.lit(0))
    full_low, full_high = stats.wilson(F.lit(5), F.lit(5))
    row = one(spark, low=low, high=high, fl=full_low, fh=full_high)
    assert row.low is None and row.high is None
    assert row.fh == pytest.approx(1.0) and 0 < row.fl < 1


def test_log_ratio(spark):
    row = one(
        spark,
        r=stats.prior_log_ratio(F.lit(0.666), F.lit(0.755624860770773)),
        inf=stats.prior_log_ratio(F.lit(1.0), F.lit(0.7)),
        flag=stats.prior_degenerate(F.lit(1.0), F.lit(0.7)),
    )
    assert row.r == pytest.approx(-0.43869185907287434, abs=1e-12)
    assert math.isinf(row.inf) and row.inf > 0 and row.flag


def test_degenerate_prior_moves_scores_to_the_boundary(spark):
    up = stats.shift_score(F.lit(0.97), F.lit("success"), F.lit(float("inf")))
    down = stats.shift_score(F.lit(0.97), F.lit("failure"), F.lit(float("inf")))
    row = one(spark, up=up, down=down)
    assert row.up == 1.0 and row.down == 0.0


def test_scores_of_zero_and_one_stay_finite(spark):
    row = one(spark, a=stats.logit(F.lit(0.0)), b=stats.logit(F.lit(1.0)), c=stats.log_odds(F.lit(0.0)))
    assert math.isfinite(row.a) and math.isfinite(row.b) and row.c == float("-inf")


def test_rank_correlation_undefined_on_constants(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0), ("b", 2.0, 5.0), ("b", 3.0, 4.0)], "k string, x double, y double")
    got = {r.k: r.rho for r in stats.spearman(df, ["k"], "x", "y").collect()}
    assert got["a"] is None and got["b"] == pytest.approx(0.5)


def test_jackknife_of_a_small_set(spark):
    rows = [("t", f"pair-{i:04d}", g) for i, g in enumerate([0.10, 0.20, 0.30, -0.40])]
    df = spark.createDataFrame(rows, "scope string, pair_id string, corrected_gap double")
    got = {r.left_out: (r.median_gap, r.median_abs_gap, r.sign_preserved) for r in pairs.jackknife(df, ["scope"]).collect()}
    assert got["pair-0003"][0] == pytest.approx(0.20)
    assert got["pair-0000"][0] == pytest.approx(0.20)
    assert got["pair-0002"] == (pytest.approx(0.10), pytest.approx(0.20), True)


def test_single_fold_has_no_jackknife_median(spark):
    df = spark.createDataFrame([("t", "pair-0001", 0.1)], "scope string, pair_id string, corrected_gap double")
    row = pairs.jackknife(df, ["scope"]).first()
    assert row.median_gap is None


def test_provider_rules_first_match_wins(spark):
    labels = ["minimax-m2.1@openai", "Claude-x@google", "glm-4@z-ai", "mystery"]
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    got = {r.label: r.f for r in df.select("label", corpora.provider_family("label").alias("f")).collect()}
    assert got == {
        "minimax-m2.1@openai": "OpenAI",
        "Claude-x@google": "Anthropic",
        "glm-4@z-ai": "Zhipu/Z.ai",
        "mystery": "Other/Unknown",
    }
