"""Policy, events and post-stop queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopwise import fixed
from stopwise.functions import stats
from stopwise.operators import events, policy
from stopwise.plans.oracle import div
from stopwise.plans.registry import Query, once


@once()
def grid(t):
    return policy.policy_grid(t.preds(), fixed.THRESHOLDS, t.runs())


@once()
def decisions(t):
    return policy.apply_stop_policy(t.preds(), t.runs())


@once()
def outcomes(t):
    return policy.outcomes(decisions(t), events.detect_events(t.steps()))


DECISION = (
    "traj_id:i instance_id:s model_id:s resolved:i n_prefix_rows:i n_steps_total:i decided:b decision:s "
    "decision_step:i decision_score:d saved_steps:i"
)
TAIL = (
    "traj_id:i post_activity:b post_edit:b post_test:b post_test_pass:b post_test_fail:b post_error:b "
    "post_submission:b post_edit_count:i post_test_count:i post_steps:i first_test_pass_after_stop:s"
)

def stop_join_reports(t):
    """The report on the predictions, and on a copy that lost some runs and whose success scores moved."""
    damaged = t.preds().where(F.col("traj_id") % 50 != 3).withColumn("p_success", F.col("p_success") - 0.125)
    report = lambda preds, name: policy.stop_join_report(policy.stop_point_scores(decisions(t), preds)).withColumn("copy", F.lit(name))
    return report(t.preds(), "intact").unionByName(report(damaged, "damaged"))


QUERIES = [
    Query("b10_detect_events", "traj_id:i step_idx:i is_edit:b is_test:b is_test_pass:b is_test_fail:b is_error:b is_submit:b",
          lambda t: events.detect_events(t.steps()), "SELECT * FROM v_events"),
    Query("b10_event_totals", "step_idx:i steps:i n_edit:i n_test:i n_test_pass:i n_test_fail:i n_error:i n_submit:i",
          lambda t: events.event_totals(events.detect_events(t.steps())),
          """SELECT step_idx, count(*) AS steps, count(*) FILTER (is_edit) AS n_edit, count(*) FILTER (is_test) AS n_test,
             count(*) FILTER (is_test_pass) AS n_test_pass, count(*) FILTER (is_test_fail) AS n_test_fail,
             count(*) FILTER (is_error) AS n_error, count(*) FILTER (is_submit) AS n_submit FROM v_events GROUP BY 1"""),
    Query("b11_observability", "runs:i stop_points:i late_activity:i post_stop_edit:i post_stop_test:i post_stop_test_pass:i post_stop_submission:i",
          lambda t: events.observability(events.detect_events(t.steps())),
          """SELECT (SELECT count(DISTINCT traj_id) FROM v_events) AS runs, count(*) AS stop_points, count(*) AS late_activity,
               count(*) FILTER (e) AS post_stop_edit, count(*) FILTER (s) AS post_stop_test,
               count(*) FILTER (p) AS post_stop_test_pass, count(*) FILTER (m) AS post_stop_submission
             FROM (SELECT k.traj_id, k.k, bool_or(is_edit) AS e, bool_or(is_test) AS s, bool_or(is_test_pass) AS p, bool_or(is_submit) AS m
                   FROM (SELECT traj_id, unnest(range(1, CAST(max(step_idx) AS BIGINT))) AS k FROM v_events GROUP BY traj_id) k
                   JOIN v_events e ON e.traj_id = k.traj_id AND e.step_idx > k.k GROUP BY 1, 2) x"""),
    Query("c1_apply_stop_policy", DECISION, decisions, "SELECT * FROM v_dec"),
    Query("c1_consecutive_two", DECISION,
          lambda t: policy.apply_stop_policy(t.preds(), t.runs(), threshold=0.70, min_step=1, consecutive=2),
          """WITH h AS (
               SELECT traj_id, prefix_step_idx, 'success' AS head, p_success AS score FROM v_preds WHERE p_success >= 0.70 AND prefix_step_idx >= 1
               UNION ALL SELECT traj_id, prefix_step_idx, 'failure', p_failure FROM v_preds WHERE p_failure >= 0.70 AND prefix_step_idx >= 1),
             g AS (SELECT *, prefix_step_idx - row_number() OVER (PARTITION BY traj_id, head ORDER BY prefix_step_idx) AS island FROM h),
             p AS (SELECT *, row_number() OVER (PARTITION BY traj_id, head, island ORDER BY prefix_step_idx) AS pos FROM g),
             f AS (SELECT * FROM p WHERE pos >= 2
                   QUALIFY row_number() OVER (PARTITION BY traj_id ORDER BY prefix_step_idx, score DESC, head DESC) = 1)
             SELECT d.traj_id, instance_id, model_id, resolved, n_prefix_rows, n_steps_total, f.head IS NOT NULL AS decided,
               coalesce(f.head, 'undecided') AS decision, coalesce(f.prefix_step_idx, -1) AS decision_step, f.score AS decision_score,
               coalesce(greatest(n_steps_total - f.prefix_step_idx, 0), 0) AS saved_steps
             FROM v_dec d LEFT JOIN f ON f.traj_id = d.traj_id"""),
    Query("c2_policy_grid", DECISION + " threshold:d", grid, "SELECT * FROM v_grid"),
    Query("c3_stop_point_join", "traj_id:i model_id:s decision:s decision_step:i decision_score:d stop_score:d",
          lambda t: policy.stop_point_scores(decisions(t), t.preds()),
          """SELECT d.traj_id, model_id, decision, decision_step, decision_score,
               CASE WHEN decision = 'success' THEN p_success ELSE p_failure END AS stop_score
             FROM v_dec d LEFT JOIN v_preds p ON p.traj_id = d.traj_id AND p.prefix_step_idx = d.decision_step WHERE decided"""),
    Query("c3_stop_join_report", "copy:s model_id:s decision:s decided:i missing:i max_abs_difference:d", stop_join_reports,
          """SELECT c.copy, d.model_id, d.decision, count(*) AS decided, count(*) FILTER (p.traj_id IS NULL) AS missing,
               max(abs(d.decision_score - CASE WHEN d.decision = 'success' THEN p.p_success ELSE p.p_failure END)) AS max_abs_difference
             FROM v_dec d CROSS JOIN (VALUES ('intact'), ('damaged')) c(copy)
             LEFT JOIN (SELECT 'intact' AS copy, * FROM v_preds UNION ALL SELECT 'damaged', traj_id, prefix_step_idx, n_steps_total, p_success - 0.125, p_failure FROM v_preds WHERE traj_id % 50 <> 3) p
               ON p.copy = c.copy AND p.traj_id = d.traj_id AND p.prefix_step_idx = d.decision_step WHERE d.decided GROUP BY 1, 2, 3"""),
    Query("c4_scan_post_stop", TAIL,
          lambda t: policy.scan_post_stop(decisions(t), events.detect_events(t.steps())), "SELECT * FROM v_tail"),
    Query("c5_late_reversal_signatures", "traj_id:i model_id:s decision_step:i direction:s signature:b",
          lambda t: policy.late_reversals(outcomes(t)),
          """SELECT traj_id, model_id, decision_step, outcome_class AS direction,
               CASE WHEN outcome_class = 'FALSE_FAILURE' THEN ff_signature ELSE fs_signature END AS signature
             FROM v_out WHERE outcome_class IN ('FALSE_FAILURE', 'FALSE_SUCCESS')"""),
    Query("c6_policy_coverage", "model_id:s runs:i decided:i no_stop:i coverage:d resolve_rate:d",
          lambda t: policy.policy_coverage(decisions(t)),
          """SELECT model_id, count(*) AS runs, count(*) FILTER (decided) AS decided, count(*) FILTER (NOT decided) AS no_stop,
               avg(decided::INT) AS coverage, avg(resolved) AS resolve_rate FROM v_dec GROUP BY 1"""),
    Query("c6_policy_coverage_grid", "threshold:d runs:i decided:i no_stop:i coverage:d resolve_rate:d",
          lambda t: policy.policy_coverage(grid(t), ["threshold"]),
          """SELECT threshold, count(*) AS runs, count(*) FILTER (decided) AS decided, count(*) FILTER (NOT decided) AS no_stop,
               avg(decided::INT) AS coverage, avg(resolved) AS resolve_rate FROM v_grid GROUP BY 1"""),
    Query("c7_savings_descriptives",
          "model_id:s threshold:d runs:i decided:i coverage:d precision:d mean_decision_step:d median_decision_step:d mean_saved_steps:d total_saved_steps:i",
          lambda t: policy.savings(grid(t)),
          """SELECT model_id, threshold, count(*) AS runs, count(*) FILTER (decided) AS decided, avg(decided::INT) AS coverage,
               avg(((decision = 'success') = (resolved = 1))::INT) FILTER (decided) AS precision,
               avg(decision_step) FILTER (decided) AS mean_decision_step, median(decision_step) FILTER (decided) AS median_decision_step,
               avg(saved_steps) FILTER (decided) AS mean_saved_steps, coalesce(sum(saved_steps) FILTER (decided), 0) AS total_saved_steps
             FROM v_grid GROUP BY 1, 2"""),
    Query("c8_support_identity", "model_id:s runs:i in_all_thresholds:i identical:b",
          lambda t: policy.support_identity(grid(t), len(fixed.THRESHOLDS)),
          """SELECT model_id, count(*) AS runs, count(*) FILTER (n = 4) AS in_all_thresholds, bool_and(n = 4) AS identical
             FROM (SELECT model_id, traj_id, count(DISTINCT threshold) AS n FROM v_grid GROUP BY 1, 2) x GROUP BY 1"""),
    Query("b15_classify_outcome", "traj_id:i decision:s resolved:i outcome_class:s",
          lambda t: decisions(t).withColumn("outcome_class", policy.classify_outcome()),
          "SELECT traj_id, decision, resolved, outcome_class FROM v_outcome_class"),
    Query("b16_is_correct", "traj_id:i decision:s correct:i",
          lambda t: decisions(t).withColumn("correct", policy.is_correct()),
          "SELECT traj_id, decision, correct FROM v_outcome_class"),
    Query("b17_decision_fraction", "traj_id:i decision_fraction:d bin:s",
          lambda t: decisions(t).where("decided").select(
              "traj_id", stats.ratio("decision_step", "n_steps_total").alias("decision_fraction"),
              stats.bin_label(stats.fraction_bin("decision_step", "n_steps_total")).alias("bin")),
          f"""SELECT traj_id, f AS decision_fraction, CASE WHEN f < 0.25 THEN '0-0.25' WHEN f < 0.5 THEN '0.25-0.50'
                WHEN f < 0.75 THEN '0.50-0.75' WHEN f <= 1 THEN '0.75-1.00' END AS bin
              FROM (SELECT traj_id, {div('decision_step', 'n_steps_total')} AS f FROM v_dec WHERE decided) x"""),
    Query("w9_streaks", "traj_id:i head:s n_streaks:i longest:i first_hit:i",
          lambda t: policy.longest_streaks(t.preds(), 0.70),
          """WITH h AS (SELECT traj_id, prefix_step_idx, 'success' AS head, p_success AS score FROM v_preds
                        UNION ALL SELECT traj_id, prefix_step_idx, 'failure', p_failure FROM v_preds),
             s AS (SELECT a.traj_id, a.head, a.prefix_step_idx FROM h a WHERE a.score >= 0.70),
             starts AS (SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.traj_id = s.traj_id AND b.head = s.head AND b.prefix_step_idx = s.prefix_step_idx - 1)),
             owned AS (SELECT s.traj_id, s.head, s.prefix_step_idx, max(b.prefix_step_idx) AS start FROM s JOIN starts b
                       ON b.traj_id = s.traj_id AND b.head = s.head AND b.prefix_step_idx <= s.prefix_step_idx GROUP BY 1, 2, 3),
             sizes AS (SELECT traj_id, head, start, count(*) AS length FROM owned GROUP BY 1, 2, 3)
             SELECT traj_id, head, count(*) AS n_streaks, max(length) AS longest, min(start) AS first_hit FROM sizes GROUP BY 1, 2"""),
]
