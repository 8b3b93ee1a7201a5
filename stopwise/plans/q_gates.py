"""Rule gates and second-corpus comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopwise import fixed
from stopwise.operators import calibration as cal
from stopwise.operators import corpora, gates, profile, resample
from stopwise.operators import pairs as pr
from stopwise.plans import oracle as o
from stopwise.plans import q_calibration as qc
from stopwise.plans import q_pairs as qp
from stopwise.plans import q_resample as qr
from stopwise.plans.oracle import div, view
from stopwise.plans.q_policy import grid, outcomes
from stopwise.plans.registry import Query, once
from stopwise.sources.tables import LABELS

GATE = "criterion:s value:d required:d passed:b label:s"


def gate_sql(wide: str, checks, label: str, by: str = "") -> str:
    """Criteria as UNION ALL over one wide row per scope; ok:<name> in the label is a verdict."""
    lead = f"{by}, " if by else ""
    verdict = {name: f"coalesce({passed}, false)" for name, _, _, passed in checks}
    parts = [
        f"SELECT {lead}'{name}' AS criterion, CAST({value} AS DOUBLE) AS value, CAST({required} AS DOUBLE) AS required, "
        f"{verdict[name]} AS passed, NULL AS label FROM wide"
        for name, value, required, _ in checks
    ]
    for name in sorted(verdict, key=len, reverse=True):
        label = label.replace(f"ok:{name}", verdict[name])
    parts.append(f"SELECT {lead}'RESULT', NULL, NULL, NULL, {label} FROM wide")
    return f"WITH wide AS ({wide})\n" + "\nUNION ALL ".join(parts)


def ge(name: str, value: str, required: float):
    return (name, value, required, f"{value} >= {required}")


# ---- second corpus: models under their provider labels -----------------------------------------

def label_column():
    digit = F.substring("model_id", 1, 1).cast("int")
    return F.get(F.array(*[F.lit(x) for x in LABELS]), digit - 1)


def priors_of(t):
    return qc.coefficients(t).select("model_id", "degenerate", "test_prior", "train_prior", "prior_shift")


@once(keep=True)
def gaps(t):
    return cal.gap_table_of_cells(qr.model_cells(t), qc.coefficients(t)).join(priors_of(t), "model_id")


@once(keep=True)
def metrics(t):
    return corpora.target_metrics(gaps(t), qr.h8(t), ["model_id", "head"], label_column())


@once(keep=True)
def grid_model_cells(t):
    rows = grid(t).where(F.col("threshold").isin(*fixed.DIAGNOSTIC_THRESHOLDS))
    return cal.task_cells(cal.corrected(rows, qc.coefficients(t)), ["threshold", "model_id"])


@once(keep=True)
def metrics_grid(t):
    values = F.explode(F.array(*[F.lit(x) for x in fixed.DIAGNOSTIC_THRESHOLDS])).alias("threshold")
    groups = qc.coefficients(t).select("model_id", values)
    table = cal.gap_table_of_cells(grid_model_cells(t), groups, ["threshold", "model_id"]).join(priors_of(t), "model_id")
    boot = resample.cell_bootstrap(grid_model_cells(t), ["threshold", "model_id", "head"])
    return corpora.target_metrics(table, boot, ["threshold", "model_id", "head"], label_column())


FAMILY_SQL = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(LBL), '{p}')" for p in parts) + f" THEN '{name}'" for name, parts in fixed.PROVIDER_FAMILIES
) + f" ELSE '{fixed.PROVIDER_OTHER}' END"
family = lambda label: FAMILY_SQL.replace("LBL", label)
_label = o.pick(LABELS, "CAST(substr(model_id, 1, 1) AS INT) - 1")

view("v_metrics", f"""
SELECT g.*, b.n_valid, b.ci_lower, b.ci_median, b.ci_upper, {family(_label.replace('model_id', 'g.model_id'))} AS family,
  g.decisions >= 20 AND NOT g.degenerate AND {o.robust('g.corrected_gap', 'b.ci_lower', 'b.ci_upper')} AS robust
FROM v_gap g LEFT JOIN v_h8 b ON b.model_id = g.model_id AND b.head = g.head""")
view("v_dcor", f"""
SELECT g.*, c.log_r, ((decision = 'success') = (resolved = 1))::INT AS correct, {o.shift('g.decision_score', 'g.decision', 'c.log_r')} AS p_corrected
FROM v_grid g JOIN v_coef c ON c.model_id = g.model_id WHERE decided AND threshold < 0.96""")
view("v_dcells", "SELECT threshold, model_id, decision AS head, instance_id, count(*) AS c, sum(correct) AS k, sum(p_corrected) AS sr, sum(decision_score) AS s FROM v_dcor GROUP BY 1, 2, 3, 4")
view("v_dpoint", "SELECT threshold, model_id, head FROM v_dcells GROUP BY 1, 2, 3 HAVING sum(c) >= 20")
qr.weights_view("v_d_w", "SELECT c.* FROM v_dcells c SEMI JOIN v_dpoint p ON p.threshold = c.threshold AND p.model_id = c.model_id AND p.head = c.head",
                "threshold, model_id, head", fixed.REPLICATES, str(fixed.CELL_SEED))
view("v_dboot", qr.ci("""
SELECT w.threshold, w.model_id, w.head, w.rep, sum(w * sr) / sum(w * c) - sum(w * k) / CAST(sum(w * c) AS DOUBLE) AS value
FROM v_d_w w JOIN v_dcells c ON c.threshold = w.threshold AND c.model_id = w.model_id AND c.head = w.head AND c.instance_id = w.instance_id GROUP BY 1, 2, 3, 4""",
     "threshold, model_id, head"))
view("v_dmetrics", f"""
SELECT t.threshold, p.model_id, h.head, p.degenerate, p.test_prior, p.train_prior, coalesce(x.decisions, 0) AS decisions, coalesce(x.correct, 0) AS correct,
  x.precision, x.mean_raw_score, x.mean_corrected_score, x.raw_gap, x.corrected_gap, coalesce(x.distinct_tasks, 0) AS distinct_tasks,
  b.n_valid, b.ci_lower, b.ci_median, b.ci_upper, {family(_label.replace('model_id', 'p.model_id'))} AS family,
  coalesce(x.decisions, 0) >= 20 AND NOT p.degenerate AND {o.robust('x.corrected_gap', 'b.ci_lower', 'b.ci_upper')} AS robust
FROM v_coef p CROSS JOIN v_heads h CROSS JOIN (SELECT threshold FROM v_thresholds WHERE threshold < 0.96) t
LEFT JOIN (SELECT threshold, model_id, head, sum(c) AS decisions, sum(k) AS correct, sum(k) / CAST(sum(c) AS DOUBLE) AS precision, sum(s) / sum(c) AS mean_raw_score,
    sum(sr) / sum(c) AS mean_corrected_score, sum(s) / sum(c) - sum(k) / CAST(sum(c) AS DOUBLE) AS raw_gap,
    sum(sr) / sum(c) - sum(k) / CAST(sum(c) AS DOUBLE) AS corrected_gap, count(*) AS distinct_tasks FROM v_dcells GROUP BY 1, 2, 3) x
  ON x.threshold = t.threshold AND x.model_id = p.model_id AND x.head = h.head
LEFT JOIN v_dboot b ON b.threshold = t.threshold AND b.model_id = p.model_id AND b.head = h.head""")
view("v_robust_models", """
SELECT model_id, family, max(abs(corrected_gap)) AS max_abs_gap, string_agg(DISTINCT head, '|' ORDER BY head) AS heads, max(abs(corrected_gap)) >= 0.10 AS is_large
FROM v_metrics WHERE robust GROUP BY 1, 2""")
view("v_denominators", """
SELECT threshold, head, count(d) AS eligible_targets, coalesce(sum(d), 0) AS total_decisions, median(d) AS median_decisions, min(d) AS min_decisions,
  max(d) AS max_decisions, count(*) FILTER (d IS NOT NULL AND robust) AS robust_targets, count(d) >= 8 AS adequate
FROM (SELECT *, CASE WHEN NOT degenerate AND decisions >= 20 THEN decisions END AS d FROM v_dmetrics) x GROUP BY 1, 2""")
view("v_den_gate", """
SELECT t.threshold, coalesce(m.models, 0) AS models, coalesce(m.large, 0) AS large, coalesce(m.families, 0) AS families,
  coalesce(a.all_ok, false) AS all_adequate, coalesce(a.any_ok, false) AS any_adequate,
  coalesce(m.models >= 3 AND m.large >= 2 AND m.families >= 2, false) AS base_met,
  coalesce(m.models >= 3 AND m.large >= 2 AND m.families >= 2 AND a.all_ok, false) AS signal,
  coalesce(m.models >= 3 AND m.large >= 2 AND m.families >= 2 AND a.any_ok, false) AS signal_any_head
FROM (SELECT DISTINCT threshold FROM v_dmetrics) t
LEFT JOIN (SELECT threshold, count(*) AS models, count(*) FILTER (mx >= 0.10) AS large, count(DISTINCT family) AS families
           FROM (SELECT threshold, model_id, family, max(abs(corrected_gap)) AS mx FROM v_dmetrics WHERE robust GROUP BY 1, 2, 3) r GROUP BY 1) m ON m.threshold = t.threshold
LEFT JOIN (SELECT threshold, bool_and(adequate) AS all_ok, bool_or(adequate) AS any_ok FROM v_denominators d
           WHERE EXISTS (SELECT 1 FROM v_dmetrics x WHERE x.robust AND x.threshold = d.threshold AND x.head = d.head) GROUP BY 1) a ON a.threshold = t.threshold""")


# ---- identity ----------------------------------------------------------------------------------

def canonical_rows(t):
    """Trial rows with the canonical name their harness recorded."""
    slug, provider = corpora.split_label("model")
    name = (
        F.when(F.col("model").startswith("kimi") & (F.col("row_key") % 2 == 0), "moonshot/kimi-k2-preview")
        .when(F.col("model").startswith("qwen"), "qwen/qwen-coder")
        .when(F.col("model").startswith("local"), "lab/other-model")
        .otherwise(F.concat(F.initcap(provider), F.lit("/"), slug))
    )
    return t.trials().withColumn("canonical_name", name)


view("v_canonical", """
SELECT *, CASE WHEN model LIKE 'kimi%' AND row_key % 2 = 0 THEN 'moonshot/kimi-k2-preview' WHEN model LIKE 'qwen%' THEN 'qwen/qwen-coder'
    WHEN model LIKE 'local%' THEN 'lab/other-model'
    ELSE upper(substr(split_part(model, '@', 2), 1, 1)) || substr(split_part(model, '@', 2), 2) || '/' || split_part(model, '@', 1) END AS canonical_name
FROM v_trials""")
view("v_identity", """
SELECT model, distinct_names, rows, name,
  CASE WHEN distinct_names <> 1 THEN 'AMBIGUOUS' WHEN s AND p THEN 'CONFIRMED' WHEN s OR p THEN 'AMBIGUOUS' ELSE 'MISMATCH' END AS identity
FROM (SELECT *, lower(split_part(model, '@', 1)) = lower(substr(name, strpos(name, '/') + 1)) AS s,
        contains(model, '@') AND lower(split_part(model, '@', 2)) = lower(split_part(name, '/', 1)) AS p
      FROM (SELECT model, count(DISTINCT canonical_name) AS distinct_names, count(*) AS rows, min(canonical_name) AS name FROM v_canonical GROUP BY 1) a) b""")


# ---- cross-corpus ------------------------------------------------------------------------------

def pooled_targets(t):
    rows = qp.target_grid(t).where(F.col("in_universe") & (F.col("decisions") >= fixed.MIN_DECISIONS))
    return corpora.pooled_point(rows, ["scope", "threshold"])


def cross_rows(t):
    """First and second corpus side by side per target and diagnostic threshold."""
    first = pooled_targets(t).join(qr.h7(t).select("scope", "threshold", "ci_lower", "ci_upper"), ["scope", "threshold"], "left")
    second = pr.target_occurrences(metrics_grid(t), qp.TARGETS)
    one = first.where(F.col("threshold").isin(*fixed.DIAGNOSTIC_THRESHOLDS)).select(
        "scope", "threshold", "decisions", F.col("precision_pooled").alias("precision"), F.col("corrected_pooled").alias("corrected_score"),
        F.col("median_gap").alias("gap"), "ci_lower", "ci_upper")
    two = second.select(
        "scope", "threshold", "decisions", "precision", F.col("mean_corrected_score").alias("corrected_score"),
        F.col("corrected_gap").alias("gap"), "ci_lower", "ci_upper")
    return corpora.cross_corpus_rows(one, two)


def status_rows(t):
    both = cross_rows(t)
    pick = lambda c, v: F.max(F.when(F.col("corpus") == c, F.col(v)))
    wide = both.groupBy("scope", "threshold").agg(
        pick("first", "gap").alias("first_gap"), pick("second", "gap").alias("second_gap"), pick("second", "decisions").alias("second_decisions"),
        pick("second", "ci_lower").alias("second_lower"), pick("second", "ci_upper").alias("second_upper"))
    target_label = F.when(F.col("scope") == "TARGET_1", LABELS[0]).otherwise(LABELS[4])
    identity = corpora.identity_evidence(canonical_rows(t)).select(F.col("model").alias("label"), "identity")
    joined = wide.withColumn("label", target_label).join(identity, "label", "left")
    return gates.cross_corpus_status(joined)


view("v_pooled", """
SELECT scope, threshold, count(*) AS occurrences, sum(decisions) AS decisions, min(decisions) AS decisions_min, max(decisions) AS decisions_max,
  median(decisions) AS decisions_median, sum(correct) / CAST(sum(decisions) AS DOUBLE) AS precision_pooled, median(precision) AS precision_median,
  sum(corrected_mean * decisions) / sum(decisions) AS corrected_pooled, median(corrected_mean) AS corrected_median, median(corrected_gap) AS median_gap
FROM v_target_grid WHERE in_universe AND decisions >= 20 GROUP BY 1, 2""")
view("v_cross", """
SELECT 'first' AS corpus, p.scope, p.threshold, p.decisions, p.precision_pooled AS precision, p.corrected_pooled AS corrected_score, p.median_gap AS gap, b.ci_lower, b.ci_upper
FROM v_pooled p LEFT JOIN v_h7_recomputed b ON b.scope = p.scope AND b.threshold = p.threshold WHERE p.threshold < 0.96
UNION ALL SELECT 'second', t.scope, m.threshold, m.decisions, m.precision, m.mean_corrected_score, m.corrected_gap, m.ci_lower, m.ci_upper
FROM v_dmetrics m JOIN v_target_list t ON t.model_id = m.model_id AND t.head = m.head""")
view("v_status", f"""
SELECT s.*, first_gap, second_gap, second_decisions, second_lower, second_upper, i.identity,
  second_lower <= 0 AND second_upper >= 0 AS ci_includes_zero, sign(first_gap) = sign(second_gap) AS sign_matches,
  CASE WHEN i.identity <> 'CONFIRMED' OR coalesce(second_decisions, 0) < 20 OR second_lower IS NULL THEN 'INDETERMINATE'
    WHEN abs(second_gap) >= 0.08 AND NOT (second_lower <= 0 AND second_upper >= 0) AND sign(first_gap) = sign(second_gap) THEN 'PERSISTENT'
    WHEN abs(second_gap) < 0.04 AND second_lower <= 0 AND second_upper >= 0 THEN 'COLLAPSED'
    WHEN sign(first_gap) <> sign(second_gap) THEN 'SIGN_CHANGED' ELSE 'UNCLASSIFIED' END AS status
FROM (SELECT DISTINCT scope, threshold FROM v_cross) s
LEFT JOIN (SELECT scope, threshold, max(gap) FILTER (corpus = 'first') AS first_gap, max(gap) FILTER (corpus = 'second') AS second_gap,
    max(decisions) FILTER (corpus = 'second') AS second_decisions, max(ci_lower) FILTER (corpus = 'second') AS second_lower,
    max(ci_upper) FILTER (corpus = 'second') AS second_upper FROM v_cross GROUP BY 1, 2) x ON x.scope = s.scope AND x.threshold = s.threshold
LEFT JOIN v_identity i ON i.model = CASE WHEN s.scope = 'TARGET_1' THEN '{LABELS[0]}' ELSE '{LABELS[4]}' END""")


# ---- gates -------------------------------------------------------------------------------------

def scope_frames(t, exclude=(), scope=0):
    pairwise, long = qp.pairwise(t), qp.long_rows(t)
    if exclude:
        pairwise = pairwise.where(~F.col("agent_a").isin(*exclude) & ~F.col("agent_b").isin(*exclude))
        long = long.where(~F.col("model_id").isin(*exclude) & ~F.col("partner").isin(*exclude))
    return pairwise, qr.h4(t, exclude, scope), pr.persistence_table(long)


def j5(t, scopes):
    return gates.same_predictor_gate({name: scope_frames(t, ex, i) for i, (name, ex) in enumerate(scopes.items())})


def j5_wide(scope: str, where_pair: str, where_long: str, boot: str) -> str:
    head = lambda h: f"""
  (SELECT count(*) FROM v_pairwise WHERE eligible AND head = '{h}' {where_pair}) AS {h}_folds,
  (SELECT median(residual_gap_difference) FROM v_pairwise WHERE eligible AND head = '{h}' {where_pair}) AS {h}_median,
  (SELECT ci_lower FROM ({boot}) b WHERE head = '{h}') AS {h}_ci"""
    persist = qp.PERSIST.format(minimum=7).replace("FROM v_long", f"FROM v_long {where_long}")
    return f"SELECT '{scope}' AS scope, {head('success')}, {head('failure')}, (SELECT count(DISTINCT model_id) FROM ({persist}) p WHERE persistent) AS agents"


J5_CHECKS = [
    c for h in fixed.HEADS
    for c in (ge(f"{h}_folds", f"{h}_folds", 20), ge(f"{h}_median", f"{h}_median", 0.05), (f"{h}_ci_lower", f"{h}_ci", 0.03, f"{h}_ci > 0.03"))
] + [ge("persistent_agents", "agents", 2)]
_S = "(ok:success_folds AND ok:success_median AND ok:success_ci_lower OR ok:failure_folds AND ok:failure_median AND ok:failure_ci_lower)"
J5_LABEL = f"CASE WHEN {_S} AND ok:persistent_agents THEN 'STRONG_PASS' WHEN {_S} OR ok:persistent_agents THEN 'PARTIAL_PASS' ELSE 'NO_PASS' END"
PRIMARY = j5_wide("primary", "", "", "SELECT * FROM v_h4")
EXCLUDED = j5_wide("without_5_LOW", "AND agent_a <> '5-LOW' AND agent_b <> '5-LOW'", "WHERE model_id <> '5-LOW' AND partner <> '5-LOW'", qr.H4_EXCLUDED)


def stats_rows(t):
    return pr.occurrence_stats(qp.eligible_targets(t), ["scope"])


def j6(t):
    jack = pr.jackknife_summary(qp.eligible_targets(t), ["scope"])
    halves = pr.target_occurrences(qp.long_halves(t), qp.TARGETS).withColumn(
        "counted", (F.col("decisions") >= fixed.HALF_MIN_DECISIONS) & ~F.col("degenerate"))
    frozen = pr.universe(qp.long_rows(t), qp.TARGETS)
    return gates.target_gate(stats_rows(t), qr.h5(t), jack, halves.join(frozen, ["scope", "pair_id"], "left_semi"))


_KEEP = lambda base, lo, hi: f"(({lo} > 0 OR {hi} < 0) AND sign({lo}) = sign({base}) AND sign({hi}) = sign({base}))"
view("v_j6_wide", f"""
SELECT s.scope, s.occurrences, s.median_gap, s.median_abs_gap, s.same_sign_fraction, b.ci_lower, b.ci_upper, k.kept, k.smallest,
  ha.folds AS a_folds, ha.m AS a_median, hb.folds AS b_folds, hb.m AS b_median
FROM (SELECT scope, {qp._STATS} FROM v_universe GROUP BY 1) s LEFT JOIN v_h5_recomputed b ON b.scope = s.scope
LEFT JOIN (SELECT scope, bool_and(sign(m) = sign(full_m))::INT AS kept, min(abs(m)) AS smallest FROM (
    SELECT a.scope, a.pair_id, median(b.corrected_gap) AS m, (SELECT median(corrected_gap) FROM v_universe u WHERE u.scope = a.scope) AS full_m
    FROM v_universe a LEFT JOIN v_universe b ON b.scope = a.scope AND b.pair_id <> a.pair_id GROUP BY 1, 2) x GROUP BY 1) k ON k.scope = s.scope
LEFT JOIN v_half_folds ha ON ha.scope = s.scope AND ha.half = 'A' LEFT JOIN v_half_folds hb ON hb.scope = s.scope AND hb.half = 'B'""")
view("v_half_folds", """
SELECT t.scope, l.half, count(*) AS folds, median(l.corrected_gap) AS m FROM v_long_half l JOIN v_target_list t ON t.model_id = l.model_id AND t.head = l.head
SEMI JOIN v_universe u ON u.scope = t.scope AND u.pair_id = l.pair_id WHERE l.decisions >= 10 AND NOT l.degenerate GROUP BY 1, 2""")
_HALF = lambda h: f"{h}_folds >= 5 AND sign({h}_median) = sign(median_gap) AND abs({h}_median) >= 0.06"
J6_CHECKS = [
    ge("A_occurrences", "occurrences", 7), ge("B_median_abs_gap", "median_abs_gap", 0.08), ge("C_same_sign", "same_sign_fraction", 0.80),
    ("D_interval_keeps_sign", "ci_lower", "NULL", _KEEP("median_gap", "ci_lower", "ci_upper")), ge("E_jackknife_sign", "kept", 1.0),
    ge("F_jackknife_gap", "smallest", 0.06), ("G_half_A", "a_median", 0.06, _HALF("a")), ("H_half_B", "b_median", 0.06, _HALF("b")),
]
J6_SQL = gate_sql("SELECT * FROM v_j6_wide", J6_CHECKS,
                  "CASE WHEN " + " AND ".join(f"ok:{c[0]}" for c in J6_CHECKS) + " THEN 'TARGET_ROBUST' ELSE 'NOT_ROBUST' END", "scope")


def j7_points(t):
    rows = pr.occurrence_stats(qp.target_grid(t).where(F.col("in_universe") & (F.col("decisions") >= fixed.MIN_DECISIONS)), ["scope", "threshold"])
    return gates.threshold_points(rows, qr.h7(t), stats_rows(t))


J7_CHECKS = [
    ge("A_occurrences", "occurrences", 7), ge("B_median_abs_gap", "median_abs_gap", 0.06), ge("C_same_sign", "same_sign_fraction", 0.75),
    ("D_interval_keeps_sign", "ci_lower", "NULL", _KEEP("base", "ci_lower", "ci_upper")),
]
view("v_j7_wide", f"""
SELECT s.*, b.ci_lower, b.ci_upper, u.base FROM (SELECT scope, threshold, {qp._STATS} FROM v_target_grid WHERE in_universe AND decisions >= 20 GROUP BY 1, 2) s
LEFT JOIN v_h7_recomputed b ON b.scope = s.scope AND b.threshold = s.threshold
LEFT JOIN (SELECT scope, median(corrected_gap) AS base FROM v_universe GROUP BY 1) u ON u.scope = s.scope""")
J7_SQL = gate_sql("SELECT * FROM v_j7_wide", J7_CHECKS,
                  "CASE WHEN " + " AND ".join(f"ok:{c[0]}" for c in J7_CHECKS) + " THEN 'ROBUST' ELSE 'NOT_ROBUST' END", "scope, threshold")
_J7_ALL = "coalesce(occurrences >= 7 AND median_abs_gap >= 0.06 AND same_sign_fraction >= 0.75 AND " + _KEEP("base", "ci_lower", "ci_upper") + ", false)"
J7_GATE = gate_sql(
    f"SELECT scope, count(*) FILTER (ok) AS passed_n, coalesce(bool_or(ok AND threshold = 0.95), false)::INT AS prim FROM (SELECT *, {_J7_ALL} AS ok FROM v_j7_wide) x GROUP BY 1",
    [ge("thresholds_passed", "passed_n", 3), ge("primary_threshold", "prim", 1.0)],
    "CASE WHEN ok:thresholds_passed AND ok:primary_threshold THEN 'TARGET_THRESHOLD_ROBUST' ELSE 'NOT_ROBUST' END", "scope")

J1_SQL = gate_sql(
    f"""SELECT ff + fs AS errors, {div('greatest(ff, fs)', 'ff + fs')} AS share, CASE WHEN ff >= fs THEN ffm ELSE fsm END AS models,
      CASE WHEN ff >= fs THEN {div('ffx', 'ff')} ELSE {div('fsx', 'fs')} END AS largest, CASE WHEN ff >= fs THEN ffr ELSE fsr END AS rate
    FROM (SELECT count(*) FILTER (direction = 'FALSE_FAILURE') AS ff, count(*) FILTER (direction = 'FALSE_SUCCESS') AS fs,
            count(DISTINCT model_id) FILTER (direction = 'FALSE_FAILURE') AS ffm, count(DISTINCT model_id) FILTER (direction = 'FALSE_SUCCESS') AS fsm,
            avg(signature::INT) FILTER (direction = 'FALSE_FAILURE') AS ffr, avg(signature::INT) FILTER (direction = 'FALSE_SUCCESS') AS fsr FROM v_dirs WHERE is_error) a,
         (SELECT max(n) FILTER (direction = 'FALSE_FAILURE') AS ffx, max(n) FILTER (direction = 'FALSE_SUCCESS') AS fsx
          FROM (SELECT direction, model_id, count(*) AS n FROM v_dirs WHERE is_error GROUP BY 1, 2) m) b""",
    [ge("A_errors", "errors", 10), ge("B_dominant_share", "share", 0.70), ge("C_models_with_error", "models", 3),
     ("D_largest_model_share", "largest", 0.60, "largest <= 0.60"), ge("E_signature_rate", "rate", 0.50)],
    "CASE WHEN ok:A_errors AND ok:B_dominant_share AND ok:C_models_with_error AND ok:D_largest_model_share AND ok:E_signature_rate THEN 'GO_CANDIDATE' ELSE 'NO_STRONG_SIGNAL' END")

_J2 = lambda t, lo: f"{t}_rd >= 0.30 AND {lo} > 0 AND {t}_n >= 30 AND {t}_m >= 3"
J2_SQL = gate_sql(
    "SELECT " + ", ".join(
        f"(SELECT std_risk_difference FROM v_standard WHERE direction = '{d}') AS {t}_rd, (SELECT n_error FROM v_standard WHERE direction = '{d}') AS {t}_n, "
        f"(SELECT models_with_error FROM v_standard WHERE direction = '{d}') AS {t}_m, (SELECT ci_lower FROM v_h1 WHERE statistic = '{t}_risk_difference_std') AS {t}_lo"
        for t, d in (("fs", "FALSE_SUCCESS"), ("ff", "FALSE_FAILURE"))),
    [("FS_enriched", "fs_rd", 0.20, "fs_rd >= 0.20 AND fs_lo > 0"), ("FS_one_direction", "fs_rd", 0.30, _J2("fs", "fs_lo")),
     ("FF_enriched", "ff_rd", 0.20, "ff_rd >= 0.20 AND ff_lo > 0"), ("FF_one_direction", "ff_rd", 0.30, _J2("ff", "ff_lo"))],
    "CASE WHEN ok:FS_enriched AND ok:FF_enriched THEN 'ROBUST_BIDIRECTIONAL_SIGNAL' WHEN ok:FS_one_direction OR ok:FF_one_direction THEN 'ROBUST_ONE_DIRECTION_SIGNAL' ELSE 'SIGNAL_NOT_YET_ROBUST' END")


def _rho(where: str) -> str:
    return f"WITH k AS (SELECT g.head, g.prior_shift, r.error FROM v_gap g JOIN v_rel r ON r.model_id = g.model_id AND r.head = g.head WHERE g.decisions > 0 {where}) " + o.spearman("k", "head", "prior_shift", "error")


view("v_rho_all", _rho(""))
view("v_rho_excl", _rho("AND g.model_id <> '1-URGENT'"))
view("v_h2", qr.h2_sql(""))
J3_SQL = gate_sql(
    "SELECT " + ", ".join(
        f"(SELECT max(precision) - min(precision) FROM v_rel WHERE head = '{h}') AS {h}_range, (SELECT ci_lower FROM v_h2 WHERE statistic = '{h}_precision_range') AS {h}_lo, "
        f"(SELECT rho FROM v_rho_all WHERE head = '{h}') AS {h}_rho, (SELECT rho FROM v_rho_excl WHERE head = '{h}') AS {h}_rho_x" for h in fixed.HEADS)
    + ", (SELECT count(DISTINCT model_id) FROM v_gap WHERE decisions >= 20 AND abs(raw_gap) >= 0.10) AS large_models",
    [("heterogeneity_success", "success_range", 0.15, "success_range >= 0.15 AND success_lo > 0.05"),
     ("heterogeneity_failure", "failure_range", 0.15, "failure_range >= 0.15 AND failure_lo > 0.05"),
     ("prior_shift_success", "success_rho", -0.50, "success_rho <= -0.5 AND success_rho_x < 0"),
     ("prior_shift_failure", "failure_rho", 0.50, "failure_rho >= 0.5 AND failure_rho_x > 0"), ge("calibration_transfer", "large_models", 3)],
    "CASE WHEN (ok:heterogeneity_success OR ok:heterogeneity_failure)::INT + (ok:prior_shift_success OR ok:prior_shift_failure)::INT + ok:calibration_transfer::INT >= 2 THEN 'GO_CANDIDATE' ELSE 'NO_STRONG_SIGNAL' END")

_R = lambda h: f"(SELECT max(corrected_gap) - min(corrected_gap) FROM v_gap WHERE head = '{h}' AND NOT degenerate AND decisions > 0) AS {h}_range, (SELECT ci_lower FROM v_h3 WHERE head = '{h}' AND statistic = 'residual_gap_range') AS {h}_lo"
J4_SQL = gate_sql(
    f"SELECT (SELECT count(DISTINCT model_id) FROM v_gap WHERE NOT degenerate AND decisions >= 20 AND abs(corrected_gap) >= 0.10) AS large_models, {_R('success')}, {_R('failure')}",
    [ge("residual_large_gap_models", "large_models", 3), ("substantial_success", "success_range", 0.10, "success_range >= 0.10 AND success_lo > 0.05"),
     ("substantial_failure", "failure_range", 0.10, "failure_range >= 0.10 AND failure_lo > 0.05")],
    """CASE WHEN ok:residual_large_gap_models AND (ok:substantial_success OR ok:substantial_failure) THEN 'GO'
       WHEN large_models <= 1 AND NOT (ok:substantial_success OR ok:substantial_failure) THEN 'PIVOT_TO_PRIOR_SHIFT_ADAPTATION' ELSE 'PARTIAL_RESIDUAL_MISCALIBRATION' END""")

J9_SQL = gate_sql(
    "SELECT count(*) AS models, count(*) FILTER (is_large) AS large, count(DISTINCT family) AS families FROM v_robust_models",
    [ge("robust_models", "models", 3), ge("large_models", "large", 2), ("families", "families", 1.0, "families > 1")],
    "CASE WHEN ok:robust_models AND ok:large_models AND ok:families THEN 'CROSS_BENCHMARK_SIGNAL' ELSE 'NO_CROSS_BENCHMARK_SIGNAL' END")

METRIC = ("model_id:s head:s family:s decisions:i correct:i precision:d mean_raw_score:d mean_corrected_score:d raw_gap:d corrected_gap:d distinct_tasks:i "
          "degenerate:b test_prior:d train_prior:d n_valid:i ci_lower:d ci_median:d ci_upper:d robust:b")
STATUS = ("scope:s threshold:d first_gap:d second_gap:d second_decisions:i second_lower:d second_upper:d identity:s ci_includes_zero:b sign_matches:b status:s")

QUERIES = [
    Query("j1_error_signal_gate", GATE, lambda t: gates.error_signal_gate(outcomes(t)), J1_SQL),
    Query("j2_signature_gate", GATE, lambda t: gates.signature_gate(profile.signature_block(profile.strata_counts(outcomes(t))), qr.h1(t)), J2_SQL),
    Query("j3_transfer_gate", GATE,
          lambda t: gates.transfer_gate(
              cal.heterogeneity(qc.reliability_long(t)), qr.h2(t),
              cal.prior_shift_correlation(qc.coefficients(t), qc.reliability_long(t), gaps(t)),
              cal.prior_shift_correlation(qc.coefficients(t), qc.reliability_long(t), gaps(t), ("1-URGENT",)),
              cal.calibration_table(qc.corrected(t), t.runs().select("model_id").distinct())), J3_SQL),
    Query("j4_residual_gate", GATE, lambda t: gates.residual_gate(gaps(t), cal.residual_range(gaps(t)), qr.h3(t)), J4_SQL),
    Query("j5_same_predictor_gate", "scope:s " + GATE, lambda t: j5(t, {"primary": ()}), gate_sql(PRIMARY, J5_CHECKS, J5_LABEL, "scope")),
    Query("j14_sensitivity_scopes", "scope:s " + GATE, lambda t: j5(t, {"primary": (), "without_5_LOW": ("5-LOW",)}),
          gate_sql(f"{PRIMARY} UNION ALL {EXCLUDED}", J5_CHECKS, J5_LABEL, "scope")),
    Query("j6_target_gate", "scope:s " + GATE, j6, J6_SQL),
    Query("j6_overall", "targets:i robust:i label:s",
          lambda t: gates.overall_targets(j6(t), "TARGET_ROBUST", ("STRONG_TARGET_SPECIFIC_SIGNAL", "SINGLE_TARGET_SIGNAL", "NO_ROBUST_TARGET_SIGNAL")),
          f"""SELECT targets, robust, CASE WHEN robust = targets THEN 'STRONG_TARGET_SPECIFIC_SIGNAL' WHEN robust > 0 THEN 'SINGLE_TARGET_SIGNAL' ELSE 'NO_ROBUST_TARGET_SIGNAL' END AS label
              FROM (SELECT count(*) AS targets, count(*) FILTER (label = 'TARGET_ROBUST') AS robust FROM ({J6_SQL}) g WHERE criterion = 'RESULT') x"""),
    Query("j7_threshold_points", "scope:s threshold:d " + GATE, j7_points, J7_SQL),
    Query("j7_threshold_gate", "scope:s " + GATE, lambda t: gates.threshold_gate(j7_points(t)), J7_GATE),
    Query("j9_replication_gate", GATE, lambda t: gates.replication_gate(metrics(t)), J9_SQL),
    Query("j10_denominator_gate", "threshold:d models:i large:i families:i all_adequate:b any_adequate:b base_met:b signal:b signal_any_head:b",
          lambda t: gates.denominator_gate(metrics_grid(t)), "SELECT * FROM v_den_gate"),
    Query("j10_denominator_result", "thresholds_with_signal:i thresholds_any_head:i result:s result_any_head:s",
          lambda t: gates.denominator_result(gates.denominator_gate(metrics_grid(t))),
          """SELECT a AS thresholds_with_signal, b AS thresholds_any_head, CASE WHEN a >= 2 THEN 'DENOMINATOR_RESOLVED_SIGNAL' ELSE 'NO_CROSS_BENCHMARK_REPLICATION' END AS result,
               CASE WHEN b >= 2 THEN 'DENOMINATOR_RESOLVED_SIGNAL' ELSE 'NO_CROSS_BENCHMARK_REPLICATION' END AS result_any_head
             FROM (SELECT count(*) FILTER (signal) AS a, count(*) FILTER (signal_any_head) AS b FROM v_den_gate) x"""),
    Query("j11_cross_corpus_status", STATUS, status_rows, "SELECT * FROM v_status"),
    Query("j11_cross_corpus_overall", "qualified:i persistent:i collapsed:i result:s",
          lambda t: gates.cross_corpus_overall(status_rows(t).where(F.col("threshold") == fixed.PRIMARY_THRESHOLD)),
          """SELECT q AS qualified, p AS persistent, c AS collapsed, CASE WHEN n > q THEN 'INSUFFICIENT_CROSS_BENCHMARK_SUPPORT' WHEN p = q AND q > 0 THEN 'BOTH_PERSIST'
               WHEN p = 1 THEN 'ONE_PERSISTS' WHEN c = q AND q > 0 THEN 'BOTH_COLLAPSE' ELSE 'INSUFFICIENT_CROSS_BENCHMARK_SUPPORT' END AS result
             FROM (SELECT count(*) AS n, count(*) FILTER (identity = 'CONFIRMED') AS q, count(*) FILTER (status = 'PERSISTENT') AS p,
                     count(*) FILTER (status = 'COLLAPSED') AS c FROM v_status WHERE threshold = 0.95) x"""),
    Query("e29_target_metrics", METRIC, metrics, "SELECT * FROM v_metrics"),
    Query("e30_threshold_metrics", "threshold:d " + METRIC, metrics_grid, "SELECT * FROM v_dmetrics"),
    Query("e30_denominator_summary",
          "threshold:d head:s eligible_targets:i total_decisions:i median_decisions:d min_decisions:i max_decisions:i robust_targets:i adequate:b",
          lambda t: gates.denominator_summary(metrics_grid(t)), "SELECT * FROM v_denominators"),
    Query("e29_head_descriptive", "head:s eligible_targets:i gap_range:d min_gap:d max_gap:d rho_test:d rho_train:d",
          lambda t: corpora.head_descriptive(metrics(t)),
          f"""WITH u AS (SELECT * FROM v_gap WHERE NOT degenerate AND decisions >= 20), x AS ({o.spearman('u', 'head', 'test_prior', 'corrected_gap', 'rho_test')}),
              y AS ({o.spearman('u', 'head', 'train_prior', 'corrected_gap', 'rho_train')})
              SELECT b.*, x.rho_test, y.rho_train FROM (SELECT head, count(*) AS eligible_targets, max(corrected_gap) - min(corrected_gap) AS gap_range,
                min(corrected_gap) AS min_gap, max(corrected_gap) AS max_gap FROM u GROUP BY 1) b LEFT JOIN x ON x.head = b.head LEFT JOIN y ON y.head = b.head"""),
    Query("e31_provider_concentration", "family:s models:i",
          lambda t: corpora.provider_concentration(gates.robust_models(metrics(t))),
          "SELECT family, count(DISTINCT model_id) AS models FROM v_robust_models GROUP BY 1"),
    Query("e31_robust_models", "model_id:s family:s max_abs_gap:d heads:s is_large:b", lambda t: gates.robust_models(metrics(t)), "SELECT * FROM v_robust_models"),
    Query("e39_pooled_point",
          "scope:s threshold:d occurrences:i decisions:i decisions_min:i decisions_max:i decisions_median:d precision_pooled:d precision_median:d corrected_pooled:d corrected_median:d median_gap:d",
          pooled_targets, "SELECT * FROM v_pooled"),
    Query("e40_cross_benchmark_rows", "corpus:s scope:s threshold:d decisions:i precision:d corrected_score:d gap:d ci_lower:d ci_upper:d", cross_rows, "SELECT * FROM v_cross"),
    Query("e41_identity_evidence", "model:s distinct_names:i rows:i name:s identity:s",
          lambda t: corpora.identity_evidence(canonical_rows(t)), "SELECT * FROM v_identity"),
    Query("e43_swe_comparison",
          "targets:i robust_targets:i robust_models:i median_abs_gap:d max_abs_gap:d median_abs_gap_robust:d max_abs_gap_robust:d",
          lambda t: corpora.robust_comparison(metrics(t)),
          """SELECT count(*) AS targets, count(*) FILTER (robust) AS robust_targets, count(DISTINCT model_id) FILTER (robust) AS robust_models,
               median(abs(corrected_gap)) AS median_abs_gap, max(abs(corrected_gap)) AS max_abs_gap, median(abs(corrected_gap)) FILTER (robust) AS median_abs_gap_robust,
               max(abs(corrected_gap)) FILTER (robust) AS max_abs_gap_robust FROM v_metrics WHERE decisions > 0"""),
    Query("b19_split_label", "model:s slug:s provider:s canonical_name:s canonical_slug:s canonical_provider:s",
          lambda t: (lambda d, a, b: d.select("model", a[0].alias("slug"), a[1].alias("provider"), "canonical_name", b[0].alias("canonical_slug"), b[1].alias("canonical_provider")))(
              canonical_rows(t), corpora.split_label("model"), corpora.split_canonical("canonical_name")),
          """SELECT model, split_part(model, '@', 1) AS slug, CASE WHEN contains(model, '@') THEN split_part(model, '@', 2) END AS provider, canonical_name,
               substr(canonical_name, strpos(canonical_name, '/') + 1) AS canonical_slug, split_part(canonical_name, '/', 1) AS canonical_provider FROM v_canonical"""),
    Query("b20_provider_family", "model:s family:s n:i",
          lambda t: t.trials().groupBy("model").agg(F.count(F.lit(1)).alias("n")).withColumn("family", corpora.provider_family("model")),
          f"SELECT model, {family('model')} AS family, count(*) AS n FROM v_trials GROUP BY 1"),
]
