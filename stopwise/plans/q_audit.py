"""Joins, set operations and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopwise import fixed
from stopwise.operators import audit, calibration, events, folds, policy
from stopwise.operators import pairs as pr
from stopwise.plans import oracle as o
from stopwise.plans import q_calibration as qc
from stopwise.plans import q_pairs as qp
from stopwise.plans.q_coverage import combos
from stopwise.plans.q_gates import ge, gate_sql
from stopwise.plans.q_policy import decisions, grid, outcomes
from stopwise.plans.q_text import run_cells, run_lengths
from stopwise.plans.oracle import view
from stopwise.plans.registry import Query, once
from stopwise.sources import files


def shifted_grid(t):
    return policy.policy_grid(t.preds_shifted(), fixed.THRESHOLDS, t.runs())


def many_to_one(t):
    left = decisions(t).select("traj_id", "model_id", "resolved")
    return audit.join_many_to_one(left, t.preds().join(t.runs().select("traj_id", "resolved"), "traj_id"), ["traj_id"], "resolved")


def model_tasks(t, model):
    return decisions(t).where((F.col("model_id") == model) & F.col("decided") & (F.col("decision") == "failure")).select("instance_id").distinct()


@once()
def recorded(t):
    """Digests of the written texts, and a record of them in which some files are left out, altered, or no longer there."""
    from stopwise.plans.q_ingest import text_files, text_rows

    found = files.digest_files(t.spark, text_files(t), "*.traj.json")
    rows = text_rows(t)
    digest = F.when(F.col("doc_id") % 37 == 0, "altered").otherwise(F.sha2("text", 256))
    noted = rows.where(F.col("doc_id") % 31 != 0).select("file", digest.alias("sha256"))
    gone = rows.where(F.col("doc_id") % 41 == 0).select(F.concat("file", F.lit(".gone")).alias("file"), F.sha2("text", 256).alias("sha256"))
    return found, noted.unionByName(gone)


view("v_manifest", """SELECT file, CASE WHEN doc_id % 31 = 0 THEN 'UNLISTED' WHEN doc_id % 37 = 0 THEN 'MISMATCH' ELSE 'MATCH' END AS state FROM v_text_files
UNION ALL SELECT file || '.gone', 'MISSING' FROM v_text_files WHERE doc_id % 41 = 0""")


def altered_outcomes(t):
    """Stored flags, the first of them flipped in every hundredth run."""
    flag = audit.RECHECKED[0]
    return outcomes(t).where("decided").withColumn(flag, F.when(F.col("traj_id") % 100 == 0, ~F.col(flag)).otherwise(F.col(flag)))


def gap_identity(t):
    """The gap table by its own route against one from per-score counts."""
    new = qc.gaps(t)
    cells = pr.score_cells(decisions(t)).where(F.col("decision") != "undecided").join(qc.coefficients(t).select("model_id", "log_r"), "model_id")
    from stopwise.functions import stats

    n = F.col("n")
    ref = cells.withColumn("p", stats.shift_score("decision_score", "decision", "log_r")).groupBy("model_id", F.col("decision").alias("head")).agg(
        F.sum("n").alias("decisions"), F.sum("k").alias("correct"), stats.ratio(F.sum(n * F.col("decision_score")), F.sum("n")).alias("mean_raw_score"),
        stats.ratio(F.sum(n * F.col("p")), F.sum("n")).alias("mean_corrected_score"))
    return audit.identity_check(new, ref, ["model_id", "head"], ["decisions", "correct"], ["mean_raw_score", "mean_corrected_score"], 1e-9)


_A, _B = "1-URGENT", "5-LOW"
_TASKS = lambda m: f"SELECT DISTINCT instance_id FROM v_dec WHERE model_id = '{m}' AND decided AND decision = 'failure'"
_REP = """
SELECT {by} count(*) AS keys, count(*) FILTER (b.traj_id IS NULL) AS left_only, count(*) FILTER (a.traj_id IS NULL) AS right_only, count(*) FILTER (a.traj_id IS NOT NULL AND b.traj_id IS NOT NULL) AS matched,
  count(*) FILTER (a.decided <> b.decided) AS decided_mismatches, count(*) FILTER (a.decision <> b.decision) AS decision_mismatches,
  count(*) FILTER (a.decision_step <> b.decision_step) AS decision_step_mismatches, count(*) FILTER (a.saved_steps <> b.saved_steps) AS saved_steps_mismatches,
  max(abs(a.decision_score - b.decision_score)) AS decision_score_max_difference
FROM v_grid a FULL JOIN v_grid_shifted b ON b.threshold = a.threshold AND b.traj_id = a.traj_id {group}"""
REP = ("keys:i left_only:i right_only:i matched:i decided_mismatches:i decision_mismatches:i decision_step_mismatches:i saved_steps_mismatches:i decision_score_max_difference:d")

QUERIES = [
    Query("d1_join_many_to_one", "rows:i missing:i repeated:i mismatched:i", lambda t: audit.join_report(many_to_one(t)),
          """SELECT count(*) AS rows, count(*) FILTER (c.n IS NULL) AS missing, count(*) FILTER (c.n > 1) AS repeated, 0 AS mismatched
             FROM v_dec d LEFT JOIN (SELECT traj_id, count(*) AS n FROM v_preds GROUP BY 1) c ON c.traj_id = d.traj_id"""),
    Query("d2_broadcast_lookup", "traj_id:i model_id:s log_r:d", lambda t: qc.corrected(t),
          "SELECT d.traj_id, d.model_id, c.log_r FROM v_dec d JOIN v_coef c ON c.model_id = d.model_id WHERE d.decided"),
    Query("d3_reconcile", REP,
          lambda t: audit.reconcile(grid(t), shifted_grid(t), ["threshold", "traj_id"], ["decided", "decision", "decision_step", "saved_steps"], ["decision_score"]),
          _REP.format(by="", group="")),
    Query("d4_theta_tail", "traj_id:i decision_step:i step_idx:i",
          lambda t: (lambda d, e: d.join(e, (d.traj_id == e.traj_id) & (e.step_idx > d.decision_step)).select(d.traj_id, d.decision_step, e.step_idx))(
              decisions(t).where("decided").select("traj_id", "decision_step"), t.steps().select("traj_id", "step_idx")),
          "SELECT d.traj_id, d.decision_step, e.step_idx FROM v_dec d JOIN v_steps e ON e.traj_id = d.traj_id AND e.step_idx > d.decision_step WHERE d.decided"),
    Query("d7_semi_join", "traj_id:i model_id:s",
          lambda t: t.runs().join(qc.gaps(t).where(F.col("decisions") >= fixed.MIN_DECISIONS).where(F.abs("corrected_gap") >= 0.02).select("model_id"), "model_id", "left_semi"),
          "SELECT traj_id, model_id FROM v_runs WHERE model_id IN (SELECT model_id FROM v_gap WHERE decisions >= 20 AND abs(corrected_gap) >= 0.02)"),
    Query("d9_complement_join", "model_id:s n:i rest_n:i rest_prior:d",
          lambda t: calibration.prior_table(t.runs()).select("model_id", "n", F.col("train_n").alias("rest_n"), F.col("train_prior").alias("rest_prior")),
          """SELECT a.model_id, (SELECT count(*) FROM v_runs r WHERE r.model_id = a.model_id) AS n, (SELECT count(*) FROM v_runs r WHERE r.model_id <> a.model_id) AS rest_n,
               (SELECT avg(resolved) FROM v_runs r WHERE r.model_id <> a.model_id) AS rest_prior FROM (SELECT DISTINCT model_id FROM v_runs) a"""),
    Query("d10_manifest_join", "state:s files:i",
          lambda t: audit.manifest_join(*recorded(t)).groupBy("state").agg(F.count(F.lit(1)).alias("files")),
          "SELECT state, count(*) AS files FROM v_manifest GROUP BY 1"),
    Query("k1_verify_manifest", "files:i matched:i missing:i mismatched:i unlisted:i all_match:b", lambda t: audit.verify_manifest(*recorded(t)),
          """SELECT count(*) AS files, count(*) FILTER (state = 'MATCH') AS matched, count(*) FILTER (state = 'MISSING') AS missing, count(*) FILTER (state = 'MISMATCH') AS mismatched,
               count(*) FILTER (state = 'UNLISTED') AS unlisted, count(*) FILTER (state <> 'MATCH') = 0 AS all_match FROM v_manifest"""),
    Query("k2_identity_check", "left_only:i right_only:i field:s difference:d passed:b", gap_identity,
          """SELECT 0 AS left_only, 0 AS right_only, c AS field, 0.0 AS difference, true AS passed
             FROM (VALUES ('decisions'), ('correct'), ('mean_raw_score'), ('mean_corrected_score')) x(c)"""),
    Query("k3_decision_reproduction", "threshold:d model_id:s " + REP, lambda t: audit.decision_reproduction(grid(t), shifted_grid(t)),
          _REP.format(by="a.threshold, a.model_id,", group="GROUP BY a.threshold, a.model_id")),
    Query("k4_detector_recheck", "event:s runs:i hits:i mismatches:i",
          lambda t: audit.detector_recheck(altered_outcomes(t), decisions(t), events.detect_events(t.steps())),
          " UNION ALL ".join(f"SELECT '{c}' AS event, count(*) AS runs, count(*) FILTER ({c}{' > 0' if c.endswith('count') else ''}) AS hits, {'count(*) FILTER (traj_id % 100 = 0)' if c == audit.RECHECKED[0] else 0} AS mismatches FROM v_tail"
                             for c in (*audit.RECHECKED, "post_edit_count", "post_test_count"))),
    Query("k6_prediction_parity", "rows:i max_difference:d rows_over_tolerance:i ids_equal:b", lambda t: audit.prediction_parity(t.preds(), t.preds_shifted()),
          """SELECT count(*) AS rows, max(greatest(abs(a.p_success - b.p_success), abs(a.p_failure - b.p_failure))) AS max_difference,
               count(*) FILTER (greatest(abs(a.p_success - b.p_success), abs(a.p_failure - b.p_failure)) > 1e-12) AS rows_over_tolerance, true AS ids_equal
             FROM v_preds a JOIN v_preds_shifted b ON b.traj_id = a.traj_id AND b.prefix_step_idx = a.prefix_step_idx"""),
    Query("k9_policy_forensic", "class:s runs:i rows_match:i one_more_prefix:i mean_offset:d", lambda t: audit.policy_forensic(decisions(t), t.preds()),
          """SELECT outcome_class AS class, count(*) AS runs, count(*) FILTER (coalesce(c.n, 0) = d.n_prefix_rows) AS rows_match, count(*) FILTER (c.m + 1 = c.n) AS one_more_prefix,
               avg(c.m - c.n) AS mean_offset
             FROM v_outcome_class d LEFT JOIN (SELECT traj_id, count(*) AS n, max(n_steps_total) AS m FROM v_preds GROUP BY 1) c ON c.traj_id = d.traj_id GROUP BY 1"""),
    Query("j13_pipeline_feasibility", "criterion:s value:d required:d passed:b label:s", lambda t: feasibility(t),
          gate_sql(f"""SELECT (SELECT count(*) FROM v_docs) AS documents, (SELECT count(*) FROM v_docs WHERE status = 'PASS') AS mapped, (SELECT count(*) FROM v_docs WHERE stage = 'step_builder') AS errors,
               (SELECT avg((resolved IS NOT NULL)::INT) FROM v_docs WHERE status = 'PASS') AS labelled, (SELECT count(*) FROM v_events WHERE is_edit OR is_test OR is_submit) AS late,
               (SELECT max(is_edit::INT) + max(is_test::INT) + max(is_submit::INT) FROM v_events) AS signals,
               (SELECT count(*) FROM v_dec d LEFT JOIN v_grid g ON g.traj_id = d.traj_id AND g.threshold = {fixed.PRIMARY_THRESHOLD} WHERE d.decision IS DISTINCT FROM g.decision) AS changed,
               (SELECT avg((resolved IS NOT NULL)::INT) FROM v_dec WHERE decided) AS comparable""",
                   [("decisions_reproducible", "changed", 0.0, "changed = 0"), ge("decisions_comparable", "comparable", 1), ge("documents_obtainable", "documents", 1),
                    ge("labels_recoverable", "labelled", 1), ge("runs_mapped", "mapped", 1), ge("late_events_observable", "late", 1), ge("post_stop_signals", "signals", 2),
                    ("step_build_errors", "errors", 0.0, "errors = 0")],
                   """CASE WHEN changed = 0 AND comparable >= 1 AND documents >= 1 AND labelled >= 1 AND mapped >= 1 AND late >= 1 AND signals >= 2 AND errors = 0
                        THEN 'FEASIBLE' ELSE 'PARTIALLY_FEASIBLE' END""")),
    Query("s1_union_all", "traj_id:i side:s", lambda t: t.runs().select("traj_id", F.lit("runs").alias("side")).unionByName(t.preds().select("traj_id", F.lit("preds").alias("side"))),
          "SELECT traj_id, 'runs' AS side FROM v_runs UNION ALL SELECT traj_id, 'preds' FROM v_preds"),
    Query("s2_intersect_tasks", "instance_id:s", lambda t: model_tasks(t, _A).intersect(model_tasks(t, _B)), f"{_TASKS(_A)} INTERSECT {_TASKS(_B)}"),
    Query("s2_common_to_all_models", "instance_id:s",
          lambda t: (lambda d: d.groupBy("instance_id").agg(F.count_distinct("model_id").alias("m")).where(F.col("m") == d.select(F.count_distinct("model_id")).scalar()))(
              decisions(t).where("decided").select("instance_id", "model_id").distinct()),
          """SELECT instance_id FROM v_dec WHERE decided GROUP BY 1 HAVING count(DISTINCT model_id) = (SELECT count(DISTINCT model_id) FROM v_dec WHERE decided)"""),
    Query("s3_symmetric_difference", "traj_id:i side:s", lambda t: sym_diff(t),
          """SELECT traj_id, 'only_900' AS side FROM (SELECT traj_id FROM v_grid WHERE threshold = 0.9 AND decided EXCEPT SELECT traj_id FROM v_grid WHERE threshold = 0.975 AND decided) a
             UNION ALL SELECT traj_id, 'only_975' FROM (SELECT traj_id FROM v_grid WHERE threshold = 0.975 AND decided EXCEPT SELECT traj_id FROM v_grid WHERE threshold = 0.9 AND decided) b"""),
    Query("s4_distinct_pairs", "model_id:s instance_id:s", lambda t: t.runs().select("model_id", "instance_id").distinct(), "SELECT DISTINCT model_id, instance_id FROM v_runs"),
]


def sym_diff(t):
    """Multiset differences both ways, from one count of both sides per run."""
    at = lambda x: F.count_if(F.col("threshold") == x)
    sides = grid(t).where(F.col("threshold").isin(0.900, 0.975) & F.col("decided")).groupBy("traj_id").agg((at(0.900) - at(0.975)).cast("int").alias("more"))
    side = F.when(F.col("more") > 0, "only_900").otherwise("only_975")
    return sides.select("traj_id", F.explode(F.array_repeat(side, F.abs("more"))).alias("side"))


def feasibility(t):
    from stopwise.operators import gates, ingest
    from stopwise.plans.q_ingest import checked

    mapped = checked(t)
    docs = mapped.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("status") == "PASS").alias("runs_mapped"),
        F.count_if(F.col("stage") == "step_builder").alias("step_build_errors"),
        F.avg(F.when(F.col("status") == "PASS", ingest.resolved().isNotNull().cast("int"))).alias("labelled"),
    )
    kinds = [F.max(F.col(c).cast("int")) for c in ("is_edit", "is_test", "is_submit")]
    seen = events.detect_events(t.steps()).agg(F.count_if(F.col("is_edit") | F.col("is_test") | F.col("is_submit")).alias("late_events"), sum(kinds[1:], kinds[0]).alias("signals"))
    again = grid(t).where(F.col("threshold") == fixed.PRIMARY_THRESHOLD).select("traj_id", F.col("decision").alias("other"))
    own = decisions(t).join(again, "traj_id", "left").agg(
        F.count_if(~F.col("decision").eqNullSafe(F.col("other"))).alias("changed"),
        F.avg(F.when(F.col("decided"), F.col("resolved").isNotNull().cast("int"))).alias("comparable"),
    )
    names = ["documents", "runs_mapped", "step_build_errors", "labelled", "late_events", "signals", "changed", "comparable"]
    parts = [(docs, names[:4]), (seen, names[4:6]), (own, names[6:])]
    wide = gates.one_row([gates.facts(frame, [], part) for frame, part in parts], names)
    none = lambda name, c: (name, F.col(c), 0.0, F.col(c) == 0)
    checks = [
        none("decisions_reproducible", "changed"),
        gates.at_least("decisions_comparable", "comparable", 1),
        gates.at_least("documents_obtainable", "documents", 1),
        gates.at_least("labels_recoverable", "labelled", 1),
        gates.at_least("runs_mapped", "runs_mapped", 1),
        gates.at_least("late_events_observable", "late_events", 1),
        gates.at_least("post_stop_signals", "signals", 2),
        none("step_build_errors", "step_build_errors"),
    ]
    return gates.gate(wide, checks, lambda ok: F.when(gates._all(ok), "FEASIBLE").otherwise("PARTIALLY_FEASIBLE"))
