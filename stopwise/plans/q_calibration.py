"""Priors, calibration gaps and scalar statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopwise import fixed
from stopwise.functions import stats
from stopwise.operators import calibration as cal
from stopwise.operators import quantiles
from stopwise.plans import oracle as o
from stopwise.plans.q_policy import decisions
from stopwise.plans.registry import Query, once


@once()
def coefficients(t):
    return cal.correction_table(cal.prior_table(t.runs()))


@once()
def corrected(t):
    return cal.corrected(decisions(t), coefficients(t))


@once()
def gaps(t):
    coef = coefficients(t)
    table = cal.gap_table(corrected(t), coef)
    return table.join(coef.select("model_id", "degenerate", "test_prior", "train_prior", "prior_shift"), "model_id")


@once()
def reliability_long(t):
    return cal.by_head(cal.reliability_table(decisions(t)))


GAP = (
    "model_id:s head:s decisions:i correct:i precision:d mean_raw_score:d mean_corrected_score:d raw_gap:d corrected_gap:d distinct_tasks:i"
)

QUERIES = [
    Query("e1_prior_table", "model_id:s n:i r:i test_prior:d train_n:i train_prior:d prior_shift:d",
          lambda t: cal.prior_table(t.runs()), "SELECT * FROM v_prior"),
    Query("e2_reliability_table",
          "model_id:s runs:i success_decisions:i success_correct:i success_false:i success_precision:d success_error:d failure_decisions:i "
          "failure_correct:i failure_false:i failure_precision:d failure_error:d no_stop:i final_failures:i",
          lambda t: cal.reliability_table(decisions(t)),
          """SELECT s.model_id, d.runs, s.n AS success_decisions, s.correct AS success_correct, s.wrong AS success_false,
               s.precision AS success_precision, s.error AS success_error, f.n AS failure_decisions, f.correct AS failure_correct,
               f.wrong AS failure_false, f.precision AS failure_precision, f.error AS failure_error, d.no_stop, d.final_failures
             FROM v_rel s JOIN v_rel f ON f.model_id = s.model_id AND s.head = 'success' AND f.head = 'failure'
             JOIN (SELECT model_id, count(*) AS runs, count(*) FILTER (NOT decided) AS no_stop, count(*) FILTER (resolved = 0) AS final_failures
                   FROM v_dec GROUP BY 1) d ON d.model_id = s.model_id"""),
    Query("e6_calibration_table",
          "model_id:s head:s decisions:i correct:i precision:d mean_score:d gap:d abs_gap:d enough:b large:b",
          lambda t: cal.calibration_table(corrected(t), t.runs().select("model_id").distinct()),
          """SELECT m.model_id, h.head, count(c.traj_id) AS decisions, coalesce(sum(c.correct), 0) AS correct, avg(c.correct) AS precision,
               avg(c.decision_score) AS mean_score, avg(c.decision_score) - avg(c.correct) AS gap,
               abs(avg(c.decision_score) - avg(c.correct)) AS abs_gap, count(c.traj_id) >= 20 AS enough,
               coalesce(abs(avg(c.decision_score) - avg(c.correct)) >= 0.10, false) AS large
             FROM (SELECT DISTINCT model_id FROM v_runs UNION ALL SELECT '__POOLED__') m CROSS JOIN v_heads h
             LEFT JOIN v_cor c ON (c.model_id = m.model_id OR m.model_id = '__POOLED__') AND c.decision = h.head GROUP BY 1, 2"""),
    Query("e7_gap_table", GAP + " absorbed_share:d", gaps,
          f"SELECT *, {o.div('abs(raw_gap) - abs(corrected_gap)', 'abs(raw_gap)')} AS absorbed_share FROM v_gap"),
    Query("e8_heterogeneity",
          "head:s models:i max_value:d min_value:d value_range:d std_dev:d argmax_model:s argmin_model:s",
          lambda t: cal.heterogeneity(reliability_long(t)),
          """SELECT head, count(precision) AS models, max(precision) AS max_value, min(precision) AS min_value,
               max(precision) - min(precision) AS value_range, stddev_pop(precision) AS std_dev,
               (list(model_id ORDER BY precision DESC, model_id))[1] AS argmax_model, (list(model_id ORDER BY precision, model_id))[1] AS argmin_model
             FROM v_rel WHERE precision IS NOT NULL GROUP BY 1"""),
    Query("e8_heterogeneity_excluding",
          "head:s models:i max_value:d min_value:d value_range:d std_dev:d argmax_model:s argmin_model:s",
          lambda t: cal.heterogeneity(reliability_long(t), exclude=("5-LOW",)),
          """SELECT head, count(precision) AS models, max(precision) AS max_value, min(precision) AS min_value,
               max(precision) - min(precision) AS value_range, stddev_pop(precision) AS std_dev,
               (list(model_id ORDER BY precision DESC, model_id))[1] AS argmax_model, (list(model_id ORDER BY precision, model_id))[1] AS argmin_model
             FROM v_rel WHERE precision IS NOT NULL AND model_id <> '5-LOW' GROUP BY 1"""),
    Query("e9_residual_range",
          "head:s models:i raw_range:d residual_range:d absorbed:d absorbed_share:d max_abs_raw:d max_abs_residual:d",
          lambda t: cal.residual_range(gaps(t)),
          f"""SELECT head, count(*) AS models, max(raw_gap) - min(raw_gap) AS raw_range, max(corrected_gap) - min(corrected_gap) AS residual_range,
               (max(raw_gap) - min(raw_gap)) - (max(corrected_gap) - min(corrected_gap)) AS absorbed,
               {o.div('(max(raw_gap) - min(raw_gap)) - (max(corrected_gap) - min(corrected_gap))', '(max(raw_gap) - min(raw_gap))')} AS absorbed_share,
               max(abs(raw_gap)) AS max_abs_raw, max(abs(corrected_gap)) AS max_abs_residual
             FROM v_gap WHERE NOT degenerate AND decisions > 0 GROUP BY 1"""),
    Query("e29_head_signal",
          "head:s eligible_targets:i median_abs_gap:d max_abs_gap:d gap_range:d min_gap:d max_gap:d n_ge_005:i n_ge_008:i n_ge_010:i",
          lambda t: cal.head_signal(gaps(t)),
          """SELECT head, count(*) AS eligible_targets, median(abs(corrected_gap)) AS median_abs_gap, max(abs(corrected_gap)) AS max_abs_gap,
               max(corrected_gap) - min(corrected_gap) AS gap_range, min(corrected_gap) AS min_gap, max(corrected_gap) AS max_gap,
               count(*) FILTER (abs(corrected_gap) >= 0.05) AS n_ge_005, count(*) FILTER (abs(corrected_gap) >= 0.08) AS n_ge_008,
               count(*) FILTER (abs(corrected_gap) >= 0.10) AS n_ge_010
             FROM v_gap WHERE NOT degenerate AND decisions >= 20 GROUP BY 1"""),
    Query("e45_pooled_gap", "head:s decisions:i pooled_raw_gap:d pooled_corrected_gap:d",
          lambda t: cal.pooled_gap(gaps(t)),
          """SELECT head, sum(decisions) AS decisions, sum(decisions * raw_gap) / sum(decisions) AS pooled_raw_gap,
               sum(decisions * corrected_gap) / sum(decisions) AS pooled_corrected_gap FROM v_gap WHERE decisions > 0 GROUP BY 1"""),
    Query("e49_prior_shift_correlation", "head:s measure:s n_rho:i rho:d",
          lambda t: cal.prior_shift_correlation(coefficients(t), reliability_long(t), gaps(t)),
          """WITH m AS (SELECT g.head, g.degenerate, g.prior_shift, u.measure,
                 CASE u.measure WHEN 'error_rate' THEN r.error WHEN 'raw_gap' THEN g.raw_gap ELSE g.corrected_gap END AS value
               FROM v_gap g JOIN v_rel r ON r.model_id = g.model_id AND r.head = g.head,
                    (VALUES ('error_rate'), ('raw_gap'), ('corrected_gap')) u(measure) WHERE g.decisions > 0),
             k AS (SELECT * FROM m WHERE measure = 'error_rate' OR NOT degenerate) """ + o.spearman("k", "head, measure", "prior_shift", "value")),
    Query("e49_prior_shift_correlation_excluding", "head:s measure:s n_rho:i rho:d",
          lambda t: cal.prior_shift_correlation(coefficients(t), reliability_long(t), gaps(t), exclude=("1-URGENT",)),
          """WITH m AS (SELECT g.head, g.degenerate, g.prior_shift, u.measure,
                 CASE u.measure WHEN 'error_rate' THEN r.error WHEN 'raw_gap' THEN g.raw_gap ELSE g.corrected_gap END AS value
               FROM v_gap g JOIN v_rel r ON r.model_id = g.model_id AND r.head = g.head,
                    (VALUES ('error_rate'), ('raw_gap'), ('corrected_gap')) u(measure) WHERE g.decisions > 0 AND g.model_id <> '1-URGENT'),
             k AS (SELECT * FROM m WHERE measure = 'error_rate' OR NOT degenerate) """ + o.spearman("k", "head, measure", "prior_shift", "value")),
    Query("g1_safe_ratio", "traj_id:i saved_share:d",
          lambda t: decisions(t).select("traj_id", stats.ratio("saved_steps", "n_steps_total").alias("saved_share")),
          f"SELECT traj_id, {o.div('saved_steps', 'n_steps_total')} AS saved_share FROM v_dec"),
    Query("g2_wilson", "model_id:s rate_name:s k:i denominator:i rate:d lower:d upper:d",
          lambda t: cal.wilson_long(reliability_long(t)),
          f"""SELECT model_id, rate_name, k, n AS denominator, {o.div('k', 'n')} AS rate, {o.wilson_low('k', 'n')} AS lower, {o.wilson_high('k', 'n')} AS upper
              FROM (SELECT model_id, head || '_precision' AS rate_name, correct AS k, n FROM v_rel
                    UNION ALL SELECT model_id, head || '_error', wrong, n FROM v_rel) x"""),
    Query("g3_logit", "traj_id:i prefix_step_idx:i z_success:d z_failure:d",
          lambda t: t.preds().withColumns({"z_success": stats.logit("p_success"), "z_failure": stats.logit("p_failure")}),
          f"SELECT traj_id, prefix_step_idx, {o.logit('p_success')} AS z_success, {o.logit('p_failure')} AS z_failure FROM v_preds"),
    Query("g4_sigmoid", "traj_id:i prefix_step_idx:i s_pos:d s_neg:d s_inf:d",
          lambda t: t.preds().withColumns({
              "s_pos": stats.sigmoid(F.col("p_success") * 20), "s_neg": stats.sigmoid(F.col("p_failure") * -900),
              "s_inf": stats.sigmoid(stats.log_odds(F.floor("p_success")))}),
          f"""SELECT traj_id, prefix_step_idx, {o.sigmoid('p_success * 20')} AS s_pos, {o.sigmoid('p_failure * -900')} AS s_neg,
              CASE WHEN p_success >= 1 THEN 1.0 ELSE 0.0 END AS s_inf FROM v_preds"""),
    Query("g5_log_odds", "traj_id:i prefix_step_idx:i lo_success:d lo_failure:d",
          lambda t: t.preds().withColumns({"lo_success": stats.log_odds("p_success"), "lo_failure": stats.log_odds("p_failure")}),
          f"SELECT traj_id, prefix_step_idx, {o.log_odds('p_success')} AS lo_success, {o.log_odds('p_failure')} AS lo_failure FROM v_preds"),
    Query("g6_prior_coefficient", "model_id:s test_prior:d train_prior:d test_odds:d train_odds:d log_r:d degenerate:b reason:s",
          coefficients,
          """SELECT model_id, test_prior, train_prior, test_prior / nullif(1 - test_prior, 0) AS test_odds,
               train_prior / nullif(1 - train_prior, 0) AS train_odds, log_r, degenerate, 'NONE' AS reason FROM v_coef"""),
    Query("g6_prior_coefficient_degenerate", "model_id:s test_prior:d train_prior:d log_r:d degenerate:b reason:s",
          lambda t: cal.correction_table(cal.prior_table(t.runs().withColumn(
              "resolved", F.when(F.col("model_id") == "5-LOW", 1).otherwise(F.col("resolved"))))),
          f"""WITH r AS (SELECT model_id, CASE WHEN model_id = '5-LOW' THEN 1 ELSE resolved END AS resolved FROM v_runs),
              p AS (SELECT a.model_id, (SELECT avg(resolved) FROM r WHERE r.model_id = a.model_id) AS test_prior,
                      (SELECT avg(resolved) FROM r WHERE r.model_id <> a.model_id) AS train_prior FROM (SELECT DISTINCT model_id FROM r) a)
              SELECT model_id, test_prior, train_prior, {o.log_ratio('test_prior', 'train_prior')} AS log_r,
                {o.degenerate('test_prior', 'train_prior')} AS degenerate, CASE WHEN test_prior = 1 THEN 'TEST_PRIOR_ONE' ELSE 'NONE' END AS reason FROM p"""),
    Query("g7_correct_score", "traj_id:i decision:s decision_score:d p_corrected:d", corrected,
          "SELECT traj_id, decision, decision_score, p_corrected FROM v_cor"),
    Query("g8_percentile_ci", "model_id:s decision:s n_valid:i ci_lower:d ci_median:d ci_upper:d",
          lambda t: quantiles.exact_quantiles(decisions(t).where("decided"), ["model_id", "decision"], "decision_score", (0.025, 0.5, 0.975)).select(
              "model_id", "decision", F.col("n").alias("n_valid"), *[F.col("q")[i].alias(c) for i, c in enumerate(("ci_lower", "ci_median", "ci_upper"))]),
          """SELECT model_id, decision, count(decision_score) AS n_valid, quantile_cont(decision_score, 0.025) AS ci_lower,
               quantile_cont(decision_score, 0.5) AS ci_median, quantile_cont(decision_score, 0.975) AS ci_upper
             FROM v_dec WHERE decided GROUP BY 1, 2"""),
    Query("g9_spearman", "n_rho:i rho:d head:s",
          lambda t: stats.spearman(gaps(t), ["head"], "prior_shift", "raw_gap"), o.spearman("v_gap", "head", "prior_shift", "raw_gap")),
    Query("g10_sign_and_zero", "model_id:s head:s gap_sign:s robust:b includes_zero:b",
          lambda t: gaps(t).withColumns({
              "gap_sign": stats.sign_name("corrected_gap"),
              "robust": stats.robust("corrected_gap", F.col("corrected_gap") - 0.05, F.col("corrected_gap") + 0.05),
              "includes_zero": stats.ci_includes_zero(F.col("corrected_gap") - 0.05, F.col("corrected_gap") + 0.05)}),
          f"""SELECT model_id, head, CASE WHEN corrected_gap > 0 THEN 'positive' WHEN corrected_gap < 0 THEN 'negative' WHEN corrected_gap = 0 THEN 'zero' END AS gap_sign,
               {o.robust('corrected_gap', '(corrected_gap - 0.05)', '(corrected_gap + 0.05)')} AS robust,
               corrected_gap - 0.05 <= 0 AND corrected_gap + 0.05 >= 0 AS includes_zero FROM v_gap"""),
    Query("g11_median_mean", "model_id:s median_score:d mean_score:d",
          lambda t: quantiles.exact_quantiles(decisions(t), ["model_id"], "decision_score", (0.5,)).select("model_id", F.col("q")[0].alias("median_score")).join(
              decisions(t).groupBy("model_id").agg(F.avg("decision_score").alias("mean_score")), "model_id"),
          "SELECT model_id, median(decision_score) AS median_score, avg(decision_score) AS mean_score FROM v_dec GROUP BY 1"),
    Query("w3_average_rank", "head:s model_id:s rank:d",
          lambda t: gaps(t).select("head", "model_id", stats.average_rank("distinct_tasks", ["head"]).alias("rank")),
          """SELECT a.head, a.model_id, count(*) FILTER (b.distinct_tasks < a.distinct_tasks) + (count(*) FILTER (b.distinct_tasks = a.distinct_tasks) + 1) / 2.0 AS rank
             FROM v_gap a JOIN v_gap b ON b.head = a.head GROUP BY 1, 2"""),
]
