"""Run-level summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopwise.operators import profile
from stopwise.plans.oracle import div, view
from stopwise.plans.q_policy import outcomes
from stopwise.plans.registry import Query

view("v_dirs", f"""
SELECT * REPLACE (coalesce(fraction_bin, 3) AS fraction_bin), CASE WHEN decision = 'success' THEN 'FALSE_SUCCESS' ELSE 'FALSE_FAILURE' END AS direction, correct = 0 AS is_error,
  CASE WHEN decision = 'success' THEN fs_signature ELSE ff_signature END AS signature
FROM v_out WHERE decided""")

view("v_strata", """
SELECT g.direction, g.model_id, g.fraction_bin, count(*) FILTER (d.is_error) AS ec, count(*) FILTER (NOT d.is_error) AS cc,
  count(*) FILTER (d.is_error AND d.signature) AS ek, count(*) FILTER (NOT d.is_error AND d.signature) AS ck
FROM (SELECT direction, model_id, fraction_bin FROM (VALUES ('FALSE_SUCCESS'), ('FALSE_FAILURE')) a(direction),
        (SELECT DISTINCT model_id FROM v_runs) m, (VALUES (0), (1), (2), (3)) b(fraction_bin)) g
LEFT JOIN v_dirs d ON d.direction = g.direction AND d.model_id = g.model_id AND d.fraction_bin = g.fraction_bin
GROUP BY 1, 2, 3""")

STANDARD = f"""
SELECT direction, sum(ec) AS n_error, sum(cc) AS n_control, {div('sum(ek)', 'sum(ec)')} AS raw_error_rate, {div('sum(ck)', 'sum(cc)')} AS raw_control_rate,
  sum(ek) FILTER (ec > 0 AND cc > 0) / nullif(CAST(sum(ec) FILTER (ec > 0 AND cc > 0) AS DOUBLE), 0) AS std_error_rate,
  sum(CAST(ec AS DOUBLE) * ck / cc) FILTER (ec > 0 AND cc > 0) / nullif(sum(ec) FILTER (ec > 0 AND cc > 0), 0) AS std_control_rate,
  (sum(ek) FILTER (ec > 0 AND cc > 0) - sum(CAST(ec AS DOUBLE) * ck / cc) FILTER (ec > 0 AND cc > 0)) / nullif(sum(ec) FILTER (ec > 0 AND cc > 0), 0) AS std_risk_difference,
  coalesce(sum(ec) FILTER (ec > 0 AND cc > 0) / nullif(CAST(sum(ec) AS DOUBLE), 0), 0) AS covered_weight,
  count(*) FILTER (ec > 0 AND cc > 0) AS strata_used, count(*) FILTER (ec > 0) AS strata_with_error,
  coalesce(sum(ec) FILTER (ec > 0 AND cc > 0), 0) AS n_in_support,
  count(DISTINCT model_id) FILTER (ec > 0) AS models_with_error
FROM v_strata GROUP BY 1"""
view("v_standard", STANDARD)

_CLASS = lambda c: f"count(*) FILTER (outcome_class = '{c}')"
_ERR = "count(*) FILTER (outcome_class IN ('FALSE_SUCCESS', 'FALSE_FAILURE'))"
_RATES = " ".join(f"{c}_rate:d" for c in profile.COMPONENTS)
_RATES_SQL = ", ".join(f"avg({c}::INT) AS {c}_rate" for c in profile.COMPONENTS)
STD_COLS = (
    "direction:s n_error:i n_control:i raw_error_rate:d raw_control_rate:d std_error_rate:d std_control_rate:d "
    "std_risk_difference:d covered_weight:d strata_used:i strata_with_error:i n_in_support:i"
)


def models(t):
    return t.runs().select("model_id").distinct()


QUERIES = [
    Query("c4_trajectory_outcomes",
          "traj_id:i instance_id:s model_id:s resolved:i n_steps_total:i n_prefix_rows:i decided:b decision:s decision_step:i decision_score:d saved_steps:i "
          "decision_fraction:d fraction_bin:i outcome_class:s correct:i post_activity:b post_edit:b post_test:b post_test_pass:b post_test_fail:b "
          "post_error:b post_submission:b post_edit_count:i post_test_count:i post_steps:i first_test_pass_after_stop:s ff_signature:b fs_signature:b",
          outcomes, "SELECT * FROM v_out"),
    Query("e3_confusion_metrics",
          "early_success:i early_failure:i false_success:i false_failure:i success_error_rate:d failure_error_rate:d success_precision:d "
          "failure_precision:d error_rate_difference:d n_errors:i false_success_share:d false_failure_share:d",
          lambda t: profile.confusion_metrics(outcomes(t)),
          f"""SELECT early_success, early_failure, fs AS false_success, ff AS false_failure, {div('fs', 'early_success')} AS success_error_rate,
               {div('ff', 'early_failure')} AS failure_error_rate, 1 - {div('fs', 'early_success')} AS success_precision,
               1 - {div('ff', 'early_failure')} AS failure_precision, {div('ff', 'early_failure')} - {div('fs', 'early_success')} AS error_rate_difference,
               fs + ff AS n_errors, {div('fs', 'fs + ff')} AS false_success_share, {div('ff', 'fs + ff')} AS false_failure_share
             FROM (SELECT count(*) FILTER (decision = 'success') AS early_success, count(*) FILTER (decision = 'failure') AS early_failure,
                     {_CLASS('FALSE_SUCCESS')} AS fs, {_CLASS('FALSE_FAILURE')} AS ff FROM v_outcome_class) x"""),
    Query("e4_per_model_summary",
          "model_id:s runs:i resolved:i resolve_rate:d early_decisions:i correct_success:i correct_failure:i false_success:i false_failure:i no_stop:i "
          "decision_accuracy:d mean_decision_fraction:d class_degenerate:b",
          lambda t: profile.per_model_summary(outcomes(t)),
          f"""SELECT model_id, count(*) AS runs, sum(resolved) AS resolved, avg(resolved) AS resolve_rate, count(*) FILTER (decided) AS early_decisions,
               {_CLASS('CORRECT_SUCCESS')} AS correct_success, {_CLASS('CORRECT_FAILURE')} AS correct_failure, {_CLASS('FALSE_SUCCESS')} AS false_success,
               {_CLASS('FALSE_FAILURE')} AS false_failure, {_CLASS('NO_STOP')} AS no_stop, avg(correct) AS decision_accuracy,
               avg(decision_fraction) AS mean_decision_fraction, count(DISTINCT resolved) = 1 AS class_degenerate FROM v_out GROUP BY 1"""),
    Query("e5_error_summary",
          "runs:i early_decisions:i correct_success:i correct_failure:i false_success:i false_failure:i no_stop:i n_errors:i "
          "false_failure_fraction:d false_success_fraction:d coverage:d",
          lambda t: profile.error_summary(outcomes(t)),
          f"""SELECT count(*) AS runs, count(*) FILTER (decided) AS early_decisions, {_CLASS('CORRECT_SUCCESS')} AS correct_success,
               {_CLASS('CORRECT_FAILURE')} AS correct_failure, {_CLASS('FALSE_SUCCESS')} AS false_success, {_CLASS('FALSE_FAILURE')} AS false_failure,
               {_CLASS('NO_STOP')} AS no_stop, {_ERR} AS n_errors, {div(_CLASS('FALSE_FAILURE'), _ERR)} AS false_failure_fraction,
               {div(_CLASS('FALSE_SUCCESS'), _ERR)} AS false_success_fraction, avg(decided::INT) AS coverage FROM v_outcome_class"""),
    Query("e10_concentration",
          "outcome_class:s errors:i models_with_error:i largest_model:s largest_model_share:d unique_tasks:i max_runs_single_task:i task_with_max_runs:s",
          lambda t: profile.concentration(outcomes(t)),
          """WITH e AS (SELECT * FROM v_outcome_class WHERE outcome_class IN ('FALSE_SUCCESS', 'FALSE_FAILURE')),
             m AS (SELECT outcome_class, model_id, count(*) AS n FROM e GROUP BY 1, 2), k AS (SELECT outcome_class, instance_id, count(*) AS n FROM e GROUP BY 1, 2)
             SELECT a.outcome_class, errors, models_with_error, largest_model, largest_model_share, unique_tasks, max_runs_single_task, task_with_max_runs
             FROM (SELECT outcome_class, sum(n) AS errors, count(*) AS models_with_error, (list(model_id ORDER BY n DESC, model_id))[1] AS largest_model,
                     max(n) / CAST(sum(n) AS DOUBLE) AS largest_model_share FROM m GROUP BY 1) a
             JOIN (SELECT outcome_class, count(*) AS unique_tasks, max(n) AS max_runs_single_task, (list(instance_id ORDER BY n DESC, instance_id))[1] AS task_with_max_runs
                   FROM k GROUP BY 1) b ON b.outcome_class = a.outcome_class"""),
    Query("w5_top_k", "outcome_class:s kind:s name:s n:i position:i",
          lambda t: profile.concentration_top(outcomes(t)),
          """SELECT outcome_class, kind, name, n, row_number() OVER (PARTITION BY outcome_class, kind ORDER BY n DESC, name) AS position
             FROM (SELECT outcome_class, 'model_id' AS kind, model_id AS name, count(*) AS n FROM v_outcome_class GROUP BY ALL
                   UNION ALL SELECT outcome_class, 'instance_id', instance_id, count(*) FROM v_outcome_class GROUP BY ALL) x
             WHERE outcome_class IN ('FALSE_SUCCESS', 'FALSE_FAILURE')
             QUALIFY position <= CASE kind WHEN 'model_id' THEN 5 ELSE 10 END"""),
    Query("e11_decision_fraction_summary", "bin:s decisions:i errors:i error_rate:d false_failure:i false_success:i",
          lambda t: profile.decision_fraction_summary(outcomes(t)),
          """SELECT b.bin, count(o.traj_id) AS decisions, count(o.traj_id) FILTER (correct = 0) AS errors, 1 - avg(correct) AS error_rate,
               count(*) FILTER (outcome_class = 'FALSE_FAILURE') AS false_failure, count(*) FILTER (outcome_class = 'FALSE_SUCCESS') AS false_success
             FROM (VALUES (0, '0-0.25'), (1, '0.25-0.50'), (2, '0.50-0.75'), (3, '0.75-1.00')) b(i, bin)
             LEFT JOIN v_out o ON o.fraction_bin = b.i AND o.decided GROUP BY 1"""),
    Query("e12_length_summary",
          "outcome_class:s n:i length_mean:d length_median:d length_min:i length_max:i saved_mean:d saved_median:d step_mean:d fraction_mean:d",
          lambda t: profile.length_summary(outcomes(t)),
          """SELECT outcome_class, count(*) AS n, avg(n_steps_total) AS length_mean, median(n_steps_total) AS length_median, min(n_steps_total) AS length_min,
               max(n_steps_total) AS length_max, avg(saved_steps) AS saved_mean, median(saved_steps) AS saved_median,
               avg(decision_step) FILTER (decided) AS step_mean, avg(decision_fraction) AS fraction_mean FROM v_out GROUP BY 1"""),
    Query("e13_scope_summary", "model_id:s runs:i prefix_rows:i length_mean:d length_median:d length_min:i length_max:i",
          lambda t: profile.scope_summary(outcomes(t)),
          """SELECT coalesce(model_id, '__ALL__') AS model_id, count(*) AS runs, sum(n_prefix_rows) AS prefix_rows, avg(n_steps_total) AS length_mean,
               median(n_steps_total) AS length_median, min(n_steps_total) AS length_min, max(n_steps_total) AS length_max
             FROM v_dec GROUP BY ROLLUP (model_id)"""),
    Query("e14_signature_summary", f"outcome_class:s errors:i signature_count:i signature_rate:d {_RATES} first_pass_true:i",
          lambda t: profile.signature_summary(outcomes(t)),
          f"""SELECT outcome_class, count(*) AS errors, count(*) FILTER (signature) AS signature_count, avg(signature::INT) AS signature_rate, {_RATES_SQL},
               count(*) FILTER (first_test_pass_after_stop = 'TRUE') AS first_pass_true FROM v_dirs WHERE is_error GROUP BY 1"""),
    Query("e15_post_stop_profile",
          f"direction:s is_error:b n:i {_RATES} signature_rate:d steps_mean:d steps_median:d steps_min:i steps_max:i steps_p25:d steps_p75:d zero_steps_rate:d",
          lambda t: profile.post_stop_profile(outcomes(t)),
          f"""SELECT direction, is_error, count(*) AS n, {_RATES_SQL}, avg(signature::INT) AS signature_rate, avg(post_steps) AS steps_mean,
               median(post_steps) AS steps_median, min(post_steps) AS steps_min, max(post_steps) AS steps_max, quantile_cont(post_steps, 0.25) AS steps_p25,
               quantile_cont(post_steps, 0.75) AS steps_p75, avg((post_steps = 0)::INT) AS zero_steps_rate FROM v_dirs GROUP BY 1, 2"""),
    Query("e16_strata_table", "direction:s model_id:s bin:s ec:i cc:i rate_error:d rate_control:d risk_difference:d usable:b",
          lambda t: profile.strata_table(outcomes(t), models(t)),
          f"""SELECT direction, model_id, (['0-0.25', '0.25-0.50', '0.50-0.75', '0.75-1.00'])[fraction_bin + 1] AS bin, ec, cc,
               {div('ek', 'ec')} AS rate_error, {div('ck', 'cc')} AS rate_control, {div('ek', 'ec')} - {div('ck', 'cc')} AS risk_difference,
               ec > 0 AND cc > 0 AS usable FROM v_strata"""),
    Query("e17_standardized_control", STD_COLS,
          lambda t: profile.standardize(profile.strata_counts(outcomes(t)), ["direction"]), "SELECT * FROM v_standard"),
    Query("e18_signature_block", STD_COLS + " models_with_error:i raw_risk_difference:d composite_risk_difference:d",
          lambda t: profile.signature_block(profile.strata_counts(outcomes(t))),
          "SELECT *, raw_error_rate - raw_control_rate AS raw_risk_difference, raw_error_rate - std_control_rate AS composite_risk_difference FROM v_standard"),
    Query("w1_first_per_group", "traj_id:i n_steps_total:i first_score:d",
          lambda t: t.preds().groupBy("traj_id").agg(
              F.min_by("n_steps_total", "prefix_step_idx").alias("n_steps_total"), F.min_by("p_success", "prefix_step_idx").alias("first_score")),
          """SELECT traj_id, n_steps_total, p_success AS first_score FROM v_preds
             QUALIFY row_number() OVER (PARTITION BY traj_id ORDER BY prefix_step_idx) = 1"""),
]
