"""Task-cluster bootstraps."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopwise import fixed
from stopwise.operators import calibration as cal
from stopwise.operators import pairs as pr
from stopwise.operators import resample
from stopwise.plans import oracle as o
from stopwise.plans import q_pairs as qp
from stopwise.plans.oracle import div, view
from stopwise.plans.q_calibration import coefficients, corrected
from stopwise.plans.q_policy import decisions, outcomes
from stopwise.plans.registry import Query, once

REPS, TARGET_REPS = fixed.REPLICATES, fixed.TARGET_REPLICATES
#: Each sensitivity scope draws with a seed of its own, this far from the scope before it.
SCOPE_SEED = 100


def weights_view(name: str, tasks: str, scope: str, reps: int, seed: str) -> None:
    """Views name_ids and name: cluster numbers, and draw counts per replicate."""
    cols = [c.strip() for c in scope.split(",") if c.strip()]
    lead = "".join(f"{c}, " for c in cols)
    part = f"PARTITION BY {', '.join(cols)}" if cols else ""
    same = "".join(f" AND d.{c} = i.{c}" for c in cols)
    text = ", ".join(f"CAST({c} AS VARCHAR)" for c in [seed, *cols, "rep", "id"])
    view(f"{name}_ids", f"""
SELECT {lead} instance_id, row_number() OVER ({part} ORDER BY substr(md5(instance_id), 1, 2), instance_id) - 1 AS id, count(*) OVER ({part}) AS n
FROM (SELECT DISTINCT {lead} instance_id FROM ({tasks}) a) b""")
    view(name, f"""
SELECT {''.join(f'd.{c}, ' for c in cols)} d.rep, i.instance_id, d.w
FROM (SELECT {lead} rep, {o.draw(text, 'n')} AS id, count(*) AS w FROM {name}_ids, (SELECT unnest(range({reps})) AS rep) r GROUP BY ALL) d
JOIN {name}_ids i ON i.id = d.id{same}""")


def ci(source: str, by: str, value: str = "value") -> str:
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {lead} count({value}) AS n_valid, quantile_cont({value}, 0.025) AS ci_lower, quantile_cont({value}, 0.5) AS ci_median,
  quantile_cont({value}, 0.975) AS ci_upper FROM ({source}) c WHERE {value} IS NOT NULL AND NOT isnan({value}) {group}"""


CI = "n_valid:i ci_lower:d ci_median:d ci_upper:d"

weights_view("v_w", "SELECT instance_id FROM v_runs", "", REPS, str(fixed.SEED))

# H1
view("v_h1_strata", """
SELECT rep, direction, model_id, fraction_bin, sum(w * ec) AS ec, sum(w * cc) AS cc, sum(w * ek) AS ek, sum(w * ck) AS ck
FROM v_w JOIN (
  SELECT instance_id, direction, model_id, fraction_bin, count(*) FILTER (is_error) AS ec, count(*) FILTER (NOT is_error) AS cc,
    count(*) FILTER (is_error AND signature) AS ek, count(*) FILTER (NOT is_error AND signature) AS ck FROM v_dirs GROUP BY 1, 2, 3, 4) c
  ON c.instance_id = v_w.instance_id GROUP BY 1, 2, 3, 4""")
view("v_h1_rep", f"""
SELECT rep, direction, {div('sum(ec)', 'sum(ec) + sum(cc)')} AS rate, {div('sum(ek)', 'sum(ec)')} - {div('sum(ck)', 'sum(cc)')} AS raw,
  sum(ek - CAST(ec AS DOUBLE) * ck / nullif(cc, 0)) FILTER (ec > 0 AND cc > 0) / nullif(sum(ec) FILTER (ec > 0 AND cc > 0), 0) AS std
FROM v_h1_strata GROUP BY 1, 2""")
view("v_h1_wide", """
SELECT rep, max(rate) FILTER (direction = 'FALSE_SUCCESS') AS success_error_rate, max(rate) FILTER (direction = 'FALSE_FAILURE') AS failure_error_rate,
  max(raw) FILTER (direction = 'FALSE_SUCCESS') AS fs_raw, max(std) FILTER (direction = 'FALSE_SUCCESS') AS fs_std,
  max(raw) FILTER (direction = 'FALSE_FAILURE') AS ff_raw, max(std) FILTER (direction = 'FALSE_FAILURE') AS ff_std
FROM v_h1_rep GROUP BY 1""")
view("v_h1", ci("""
SELECT 'success_error_rate' AS statistic, success_error_rate AS value FROM v_h1_wide UNION ALL SELECT 'failure_error_rate', failure_error_rate FROM v_h1_wide
UNION ALL SELECT 'error_rate_difference', failure_error_rate - success_error_rate FROM v_h1_wide
UNION ALL SELECT 'fs_risk_difference_raw', fs_raw FROM v_h1_wide UNION ALL SELECT 'fs_risk_difference_std', fs_std FROM v_h1_wide
UNION ALL SELECT 'ff_risk_difference_raw', ff_raw FROM v_h1_wide UNION ALL SELECT 'ff_risk_difference_std', ff_std FROM v_h1_wide""", "statistic"))

# H2
view("v_h2_model", """
SELECT rep, model_id, sum(w * n) AS n, sum(w * r) AS r, sum(w * sd) AS sd, sum(w * sc) AS sc, sum(w * fd) AS fd, sum(w * fc) AS fc
FROM v_w JOIN (SELECT model_id, instance_id, count(*) AS n, sum(resolved) AS r, count(*) FILTER (decision = 'success') AS sd,
    count(*) FILTER (decision = 'success' AND resolved = 1) AS sc, count(*) FILTER (decision = 'failure') AS fd,
    count(*) FILTER (decision = 'failure' AND resolved = 0) AS fc FROM v_dec GROUP BY 1, 2) c ON c.instance_id = v_w.instance_id GROUP BY 1, 2""")
view("v_h2_shift", f"""
SELECT m.*, {div('m.r', 'm.n')} - {div('t.r - m.r', 't.n - m.n')} AS prior_shift
FROM v_h2_model m JOIN (SELECT rep, sum(n) AS n, sum(r) AS r FROM v_h2_model GROUP BY 1) t ON t.rep = m.rep""")


def h2_sql(where: str) -> str:
    return f"""
WITH l AS (SELECT rep, model_id, prior_shift, 'success' AS head, {div('sc', 'sd')} AS precision FROM v_h2_shift {where}
           UNION ALL SELECT rep, model_id, prior_shift, 'failure', {div('fc', 'fd')} FROM v_h2_shift {where}),
e AS (SELECT *, 1 - precision AS error FROM l)
""" + ci(f"""
SELECT rep, head || '_precision_range' AS statistic, max(precision) - min(precision) AS value FROM e GROUP BY rep, head
UNION ALL SELECT rep, head || '_rho_prior_shift_error', value FROM ({o.spearman('e', 'rep, head', 'prior_shift', 'error', 'value')}) s""", "statistic")


# H3
view("v_h3_model", f"""
SELECT s.rep, s.model_id, s.prior_shift, h.head, {div('sum(w * k.s)', 'sum(w * k.c)')} - {div('sum(w * k.k)', 'sum(w * k.c)')} AS raw,
  {div('sum(w * k.sr)', 'sum(w * k.c)')} - {div('sum(w * k.k)', 'sum(w * k.c)')} AS residual
FROM v_h2_shift s JOIN v_coef p ON p.model_id = s.model_id AND NOT p.degenerate CROSS JOIN v_heads h
LEFT JOIN (SELECT v_w.rep, v_w.w, c.* FROM v_w JOIN (SELECT model_id, decision, instance_id, count(*) AS c, sum(correct) AS k, sum(decision_score) AS s, sum(p_corrected) AS sr
     FROM v_cor GROUP BY 1, 2, 3) c ON c.instance_id = v_w.instance_id) k ON k.rep = s.rep AND k.model_id = s.model_id AND k.decision = h.head
GROUP BY 1, 2, 3, 4""")
view("v_h3", ci(f"""
SELECT rep, head, 'raw_gap_range' AS statistic, max(raw) - min(raw) AS value FROM v_h3_model GROUP BY rep, head
UNION ALL SELECT rep, head, 'residual_gap_range', max(residual) - min(residual) FROM v_h3_model GROUP BY rep, head
UNION ALL SELECT rep, head, 'rho_raw', value FROM ({o.spearman('v_h3_model', 'rep, head', 'prior_shift', 'raw', 'value')}) a
UNION ALL SELECT rep, head, 'rho_residual', value FROM ({o.spearman('v_h3_model', 'rep, head', 'prior_shift', 'residual', 'value')}) b""", "head, statistic"))

# H4
weights_view("v_h4_w", "SELECT pair_id, head, instance_id FROM v_common, v_heads", "pair_id, head", REPS,
             f"({fixed.SEED * 100} + CASE WHEN head = 'success' THEN 1 ELSE 2 END)")
view("v_h4_cells", f"""
SELECT p.pair_id, d.decision AS head, d.instance_id, p.side, count(*) AS n, sum(((d.decision = 'success') = (d.resolved = 1))::INT) AS k,
  sum({o.shift('d.decision_score', 'd.decision', 'p.log_r')}) AS sr
FROM v_dec d JOIN v_pprior p ON p.model_id = d.model_id JOIN v_common c ON c.pair_id = p.pair_id AND c.instance_id = d.instance_id
WHERE d.decided GROUP BY 1, 2, 3, 4""")
H4_DIFFS = """
SELECT pair_id, head, rep, abs(max(gap) FILTER (side = 'A') - max(gap) FILTER (side = 'B')) AS value
FROM (SELECT w.pair_id, w.head, w.rep, c.side, sum(w * n) AS n, sum(w * sr) / sum(w * n) - sum(w * k) / CAST(sum(w * n) AS DOUBLE) AS gap
      FROM {weights} w JOIN v_h4_cells c ON c.pair_id = w.pair_id AND c.head = w.head AND c.instance_id = w.instance_id GROUP BY 1, 2, 3, 4) x
GROUP BY 1, 2, 3 HAVING count(*) = 2 AND min(n) >= 20"""
view("v_h4_diffs", H4_DIFFS.format(weights="v_h4_w"))
view("v_h4", ci("SELECT head, rep, median(value) AS value FROM v_h4_diffs GROUP BY 1, 2", "head"))
weights_view("v_h4_w2", "SELECT pair_id, head, instance_id FROM v_common, v_heads", "pair_id, head", REPS,
             f"({fixed.SEED * 100 + SCOPE_SEED} + CASE WHEN head = 'success' THEN 1 ELSE 2 END)")
view("v_h4_diffs2", H4_DIFFS.format(weights="v_h4_w2"))
H4_EXCLUDED = ci("""SELECT head, rep, median(value) AS value FROM v_h4_diffs2
  WHERE pair_id NOT IN (SELECT pair_id FROM v_sides WHERE model_id = '5-LOW') GROUP BY 1, 2""", "head")


# H5 to H7
def target_views(name: str, folds_sql: str, dec: str, scope: str, reps: int, seed: str, on_thr: bool) -> None:
    cols = [c.strip() for c in scope.split(",")] + ["pair_id"]
    fold, lead = ", ".join(cols), ", ".join(f"w.{c}" for c in cols)
    eq = lambda x: " AND ".join(f"{x}.{c} = w.{c}" for c in cols)
    thr = "AND d.threshold = f.threshold" if on_thr else ""
    view(f"{name}_folds", folds_sql)
    weights_view(f"{name}_w", f"SELECT f.*, c.instance_id FROM {name}_folds f JOIN v_common c ON c.pair_id = f.pair_id", fold, reps, seed)
    view(f"{name}_rows", f"""
SELECT {', '.join('f.' + c for c in cols)}, f.head, d.instance_id, d.decision_score AS p, count(*) AS n, sum(((d.decision = 'success') = (d.resolved = 1))::INT) AS k
FROM {name}_folds f JOIN {dec} d ON d.model_id = f.model_id AND d.decision = f.head {thr} GROUP BY ALL""")
    view(f"{name}_prior", _ratio(f"""
SELECT {lead}, w.rep, sum(w * m.n) FILTER (m.model_id = f.model_id) AS target_n, sum(w * m.r) FILTER (m.model_id = f.model_id) AS target_r,
  sum(w * m.n) FILTER (m.model_id NOT IN (f.model_id, f.partner)) AS train_n, sum(w * m.r) FILTER (m.model_id NOT IN (f.model_id, f.partner)) AS train_r
FROM {name}_w w JOIN {name}_folds f ON {eq('f')} JOIN v_mt m ON m.instance_id = w.instance_id GROUP BY {lead}, w.rep"""))
    for kind, ratio in (("recomputed", f"JOIN {name}_prior q ON {eq('q')} AND q.rep = w.rep"), ("frozen", f"JOIN {name}_folds q ON {eq('q')}")):
        flag = "bool_or(q.degenerate)" if kind == "recomputed" else "false"
        view(f"{name}_{kind}_fold", f"""
SELECT {lead}, w.rep, sum(w * r.n) AS n, {flag} AS degenerate,
  sum(w * r.n * {o.shift('r.p', 'r.head', 'q.log_r')}) / sum(w * r.n) - sum(w * r.k) / CAST(sum(w * r.n) AS DOUBLE) AS gap
FROM {name}_w w JOIN {name}_rows r ON {eq('r')} AND r.instance_id = w.instance_id {ratio} GROUP BY {lead}, w.rep HAVING sum(w * r.n) >= 20""")
        view(f"{name}_{kind}", f"""
SELECT {scope}, count(m) AS n_valid, quantile_cont(m, 0.025) AS ci_lower, quantile_cont(m, 0.5) AS ci_median, quantile_cont(m, 0.975) AS ci_upper,
  quantile_cont(a, 0.025) AS abs_ci_lower, quantile_cont(a, 0.5) AS abs_ci_median, quantile_cont(a, 0.975) AS abs_ci_upper, count(*) FILTER (g) AS degenerate_replicates
FROM (SELECT {scope}, rep, median(gap) AS m, median(abs(gap)) AS a, bool_or(degenerate) AS g FROM {name}_{kind}_fold GROUP BY {scope}, rep) x GROUP BY {scope}""")


def _ratio(source: str) -> str:
    t, r = div("target_r", "target_n"), div("train_r", "train_n")
    return f"""SELECT *, {o.log_ratio('pi_target', 'pi_train')} AS log_r, {o.degenerate('pi_target', 'pi_train')} AS degenerate
FROM (SELECT *, {t} AS pi_target, {r} AS pi_train FROM ({source}) a) b"""


target_views("v_h5", "SELECT scope, pair_id, side, model_id, partner, head, log_r FROM v_universe", "v_dec", "scope", TARGET_REPS, str(fixed.TARGET_SEED), False)
target_views("v_h7", "SELECT scope, threshold, pair_id, side, model_id, partner, head, log_r FROM v_target_grid WHERE in_universe", "v_grid",
             "scope, threshold", REPS, str(fixed.THRESHOLD_SEED), True)

# H8
view("v_h8_cells", """SELECT model_id, decision AS head, instance_id, count(*) AS c, sum(correct) AS k, sum(p_corrected) AS sr FROM v_cor GROUP BY 1, 2, 3""")
view("v_h8_point", """SELECT model_id, head, sum(c) AS decisions, count(*) AS n_tasks, sum(sr) / sum(c) - sum(k) / CAST(sum(c) AS DOUBLE) AS point_gap
FROM v_h8_cells GROUP BY 1, 2 HAVING sum(c) >= 20""")
weights_view("v_h8_w", "SELECT c.* FROM v_h8_cells c JOIN v_h8_point p ON p.model_id = c.model_id AND p.head = c.head", "model_id, head", REPS, str(fixed.CELL_SEED))
view("v_h8", "SELECT p.*, i.* EXCLUDE (model_id, head) FROM v_h8_point p JOIN (" + ci("""
SELECT w.model_id, w.head, w.rep, sum(w * sr) / sum(w * c) - sum(w * k) / CAST(sum(w * c) AS DOUBLE) AS value
FROM v_h8_w w JOIN v_h8_cells c ON c.model_id = w.model_id AND c.head = w.head AND c.instance_id = w.instance_id GROUP BY 1, 2, 3""", "model_id, head")
     + ") i ON i.model_id = p.model_id AND i.head = p.head")


# ---- plans ------------------------------------------------------------------------------------

def h1(t):
    return resample.confusion_bootstrap(outcomes(t), t.runs().select("instance_id"), REPS, fixed.SEED)


def h2(t, exclude=()):
    return resample.precision_bootstrap(decisions(t), t.runs(), REPS, fixed.SEED, exclude)


def h3(t):
    return resample.residual_bootstrap(corrected(t), decisions(t), coefficients(t), t.runs(), REPS, fixed.SEED)


def h4(t, exclude=(), scope=0):
    priors = pr.fold_priors(qp.task_priors(t))
    return resample.pair_bootstrap(qp.cells(t), qp.sides(t), qp.common(t), priors, REPS, fixed.SEED * 100 + scope * SCOPE_SEED, exclude)


def target_folds(t):
    return qp.eligible_targets(t).select("scope", "pair_id", "side", "model_id", "head", "log_r")


def h5(t, frozen=False):
    return resample.target_bootstrap(
        target_folds(t), qp.common(t), qp.task_priors(t), qp.cells(t), ["scope"], TARGET_REPS, fixed.TARGET_SEED, frozen)


@once(keep=True)
def h7(t):
    return h7_of(t)


def h7_of(t, frozen=False):
    every = target_folds(t).withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in fixed.THRESHOLDS])))
    return resample.target_bootstrap(
        every, qp.common(t), qp.task_priors(t), qp.grid_cells(t), ["scope", "threshold"], REPS, fixed.THRESHOLD_SEED, frozen)


@once(keep=True)
def model_cells(t):
    return cal.task_cells(corrected(t), ["model_id"])


def h8(t):
    return resample.cell_bootstrap(model_cells(t), ["model_id", "head"], REPS, fixed.CELL_SEED)


TARGET_CI = f"scope:s {CI} abs_ci_lower:d abs_ci_median:d abs_ci_upper:d degenerate_replicates:i"

QUERIES = [
    Query("h0_boot_weights", "rep:i instance_id:s w:i", lambda t: resample.weights(t.runs(), [], REPS, fixed.SEED), "SELECT * FROM v_w"),
    Query("h1_confusion_bootstrap", f"statistic:s {CI}", h1, "SELECT * FROM v_h1"),
    Query("h2_precision_bootstrap", f"statistic:s {CI}", h2, h2_sql("")),
    Query("h2_precision_bootstrap_excluding", f"statistic:s {CI}", lambda t: h2(t, ("5-LOW",)), h2_sql("WHERE model_id <> '5-LOW'")),
    Query("h3_residual_bootstrap", f"head:s statistic:s {CI}", h3, "SELECT * FROM v_h3"),
    Query("h4_pair_bootstrap", f"head:s {CI}", h4, "SELECT * FROM v_h4"),
    Query("h5_target_bootstrap", TARGET_CI, h5, "SELECT * FROM v_h5_recomputed"),
    Query("h6_target_bootstrap_frozen", TARGET_CI, lambda t: h5(t, True), "SELECT * FROM v_h5_frozen"),
    Query("h7_threshold_bootstrap", "threshold:d " + TARGET_CI, h7, "SELECT * FROM v_h7_recomputed"),
    Query("h7_threshold_bootstrap_frozen", "threshold:d " + TARGET_CI, lambda t: h7_of(t, True), "SELECT * FROM v_h7_frozen"),
    Query("h8_cell_bootstrap", f"model_id:s head:s decisions:i n_tasks:i point_gap:d {CI}", h8, "SELECT * FROM v_h8"),
]
