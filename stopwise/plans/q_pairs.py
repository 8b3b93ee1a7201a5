"""Pair folds and occurrences."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopwise import fixed
from stopwise.operators import pairs as pr
from stopwise.plans import oracle as o
from stopwise.plans.oracle import div, view
from stopwise.plans.q_policy import decisions, grid
from stopwise.plans.registry import Query, once

TARGETS = (("TARGET_1", "1-URGENT", "failure"), ("TARGET_2", "5-LOW", "success"))


@once(keep=True)
def tasks(t):
    return pr.model_tasks(t.runs())


@once(keep=True)
def sides(t):
    return pr.sides(pr.unordered_pairs(tasks(t), "model_id"))


@once(keep=True)
def common(t):
    return pr.common_tasks(sides(t), tasks(t))


@once(keep=True)
def task_priors(t):
    return pr.fold_task_priors(sides(t), tasks(t), common(t))


@once(keep=True)
def cells(t):
    return pr.score_cells(decisions(t))


@once(keep=True)
def grid_cells(t):
    return pr.score_cells(grid(t), ["threshold"])


def folds(t):
    return sides(t), tasks(t), common(t)


@once(keep=True)
def long_rows(t):
    return pr.occurrences(cells(t), sides(t), common(t), pr.fold_priors(task_priors(t)))


@once()
def long_grid(t):
    return pr.occurrences(grid_cells(t), sides(t), common(t), pr.fold_priors(task_priors(t)), fixed.THRESHOLDS)


@once(keep=True)
def long_halves(t):
    halved = common(t).withColumn("half", pr.task_half("instance_id"))
    priors = pr.fold_priors(pr.fold_task_priors(sides(t), tasks(t), halved), ["half"])
    return pr.occurrences(cells(t), sides(t), halved, priors, extra=["half"])


@once()
def pairwise(t):
    return pr.pairwise_metrics(long_rows(t), pr.all_task_stats(cells(t), sides(t)))


@once()
def eligible_targets(t):
    return pr.target_occurrences(long_rows(t), TARGETS).where(F.col("eligible") & ~F.col("degenerate"))


view("v_mt", "SELECT model_id, instance_id, count(*) AS n, sum(resolved) AS r FROM v_runs GROUP BY 1, 2")
view("v_models", "SELECT model_id, row_number() OVER (ORDER BY model_id) - 1 AS i FROM (SELECT DISTINCT model_id FROM v_runs) x")
view("v_pairs", """
SELECT 'pair-' || CAST(a.i AS VARCHAR) || '-' || CAST(b.i AS VARCHAR) AS pair_id, a.model_id AS agent_a, b.model_id AS agent_b
FROM v_models a JOIN v_models b ON a.i < b.i""")
view("v_sides", """
SELECT pair_id, 'A' AS side, agent_a AS model_id, agent_b AS partner FROM v_pairs
UNION ALL SELECT pair_id, 'B', agent_b, agent_a FROM v_pairs""")
view("v_common", """
SELECT p.pair_id, a.instance_id, least(a.n, b.n) AS matched,
  CASE WHEN CAST('0x' || right(sha256(a.instance_id), 1) AS INT) % 2 = 0 THEN 'A' ELSE 'B' END AS half
FROM v_pairs p JOIN v_mt a ON a.model_id = p.agent_a JOIN v_mt b ON b.model_id = p.agent_b AND b.instance_id = a.instance_id""")


def _priors(extra: str) -> str:
    lead = f"{extra}, " if extra else ""
    return f"""
SELECT s.pair_id, s.side, s.model_id, s.partner, {lead} count(DISTINCT c.instance_id) AS n_common_tasks,
  sum(m.n) FILTER (m.model_id = s.model_id) AS target_n, sum(m.r) FILTER (m.model_id = s.model_id) AS target_r,
  sum(m.n) FILTER (m.model_id NOT IN (s.model_id, s.partner)) AS train_n, sum(m.r) FILTER (m.model_id NOT IN (s.model_id, s.partner)) AS train_r
FROM v_sides s JOIN v_common c ON c.pair_id = s.pair_id JOIN v_mt m ON m.instance_id = c.instance_id
GROUP BY s.pair_id, s.side, s.model_id, s.partner {', ' + extra if extra else ''}"""


def _with_ratio(source: str) -> str:
    t, r = div("target_r", "target_n"), div("train_r", "train_n")
    return f"""SELECT *, {o.log_ratio('pi_target', 'pi_train')} AS log_r, {o.degenerate('pi_target', 'pi_train')} AS degenerate
FROM (SELECT *, {t} AS pi_target, {r} AS pi_train FROM ({source}) a) b"""


def _long(priors: str, dec: str, key: str) -> str:
    """key: one more grouping column of the decisions (threshold) or of the common tasks (half)."""
    lead = f"{key}, " if key else ""
    on = "" if not key else ("AND d.threshold = p.threshold" if key == "threshold" else "AND c.half = p.half")
    return f"""
SELECT *, min(decisions) OVER (PARTITION BY pair_id, {lead} head) >= 20 AS eligible FROM (
SELECT pair_id, side, model_id, partner, {lead} head, n_common_tasks, target_n, target_r, train_n, train_r, pi_target, pi_train, log_r, degenerate,
  count(traj_id) AS decisions, coalesce(sum(correct), 0) AS correct, avg(correct) AS precision, avg(decision_score) AS mean_score,
  avg(p_cor) AS corrected_mean, avg(decision_score) - avg(correct) AS raw_gap, avg(p_cor) - avg(correct) AS corrected_gap,
  avg(saved_steps) AS mean_saved_steps
FROM (SELECT p.*, h.head, d.traj_id, d.decision_score, d.saved_steps,
    CASE WHEN d.traj_id IS NULL THEN NULL WHEN (d.decision = 'success') = (d.resolved = 1) THEN 1 ELSE 0 END AS correct,
    {o.shift('d.decision_score', 'h.head', 'p.log_r')} AS p_cor
  FROM ({priors}) p CROSS JOIN v_heads h
  LEFT JOIN (SELECT d.*, c.pair_id, c.half FROM {dec} d JOIN v_common c ON c.instance_id = d.instance_id) d
    ON d.pair_id = p.pair_id AND d.model_id = p.model_id AND d.decision = h.head {on.replace('c.half', 'd.half')}) x
GROUP BY ALL) y"""


view("v_pprior", _with_ratio(_priors("")))
view("v_hprior", _with_ratio(_priors("half")))
view("v_long", _long("SELECT * FROM v_pprior", "v_dec", ""))
view("v_long_grid", _long("SELECT * FROM v_pprior, v_thresholds", "v_grid", "threshold"))
view("v_long_half", _long("SELECT * FROM v_hprior", "v_dec", "half"))
view("v_all_tasks", """
SELECT s.pair_id, s.side, d.decision AS head, count(*) AS all_decisions, avg(((decision = 'success') = (resolved = 1))::INT) AS all_precision,
  avg(decision_score) - avg(((decision = 'success') = (resolved = 1))::INT) AS all_raw_gap
FROM v_sides s JOIN v_dec d ON d.model_id = s.model_id WHERE decided GROUP BY 1, 2, 3""")
_side = lambda s: ", ".join(
    f"{s}.{c} AS {s}_{c}" for c in pr.SIDE_COLUMNS if not c.startswith("all_")
) + f", coalesce({s}_all.all_decisions, 0) AS {s}_all_decisions, {s}_all.all_precision AS {s}_all_precision, {s}_all.all_raw_gap AS {s}_all_raw_gap"
_diff = lambda c, name: f"CASE WHEN a.eligible THEN abs(a.{c} - b.{c}) END AS {name}"
view("v_pairwise", f"""
SELECT a.pair_id, a.head, a.n_common_tasks, a.pi_train, a.train_n, a.eligible, {_side('a')}, {_side('b')}, a.model_id AS agent_a, b.model_id AS agent_b,
  {_diff('corrected_gap', 'residual_gap_difference')}, {_diff('raw_gap', 'raw_gap_difference')}, {_diff('precision', 'precision_difference')},
  {_diff('pi_target', 'prior_difference')}, CASE WHEN a.eligible THEN abs(a.corrected_gap) END AS abs_gap_a, CASE WHEN a.eligible THEN abs(b.corrected_gap) END AS abs_gap_b
FROM v_long a JOIN v_long b ON b.pair_id = a.pair_id AND b.head = a.head AND a.side = 'A' AND b.side = 'B'
LEFT JOIN v_all_tasks a_all ON a_all.pair_id = a.pair_id AND a_all.side = 'A' AND a_all.head = a.head
LEFT JOIN v_all_tasks b_all ON b_all.pair_id = a.pair_id AND b_all.side = 'B' AND b_all.head = a.head""")
view("v_target_list", "SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{m}', '{h}')" for s, m, h in TARGETS) + ") x(scope, model_id, head)")
view("v_targets", "SELECT t.scope, l.* FROM v_long l JOIN v_target_list t ON t.model_id = l.model_id AND t.head = l.head")
view("v_universe", "SELECT * FROM v_targets WHERE eligible AND NOT degenerate")
view("v_target_grid", """
SELECT t.scope, l.*, EXISTS (SELECT 1 FROM v_universe u WHERE u.scope = t.scope AND u.pair_id = l.pair_id) AS in_universe
FROM v_long_grid l JOIN v_target_list t ON t.model_id = l.model_id AND t.head = l.head""")

_STATS = """count(corrected_gap) AS occurrences, median(corrected_gap) AS median_gap, median(abs(corrected_gap)) AS median_abs_gap, min(corrected_gap) AS min_gap,
  max(corrected_gap) AS max_gap, avg((corrected_gap > 0)::INT) AS positive_fraction, avg((corrected_gap < 0)::INT) AS negative_fraction,
  count(*) FILTER (corrected_gap = 0) AS zero_count, greatest(avg((corrected_gap > 0)::INT), avg((corrected_gap < 0)::INT)) AS same_sign_fraction"""
STAT_COLS = (
    "occurrences:i median_gap:d median_abs_gap:d min_gap:d max_gap:d positive_fraction:d negative_fraction:d zero_count:i same_sign_fraction:d"
)
OCC_COLS = (
    "pair_id:s model_id:s head:s decisions:i correct:i precision:d mean_score:d corrected_mean:d raw_gap:d corrected_gap:d mean_saved_steps:d "
    "pi_target:d pi_train:d log_r:d degenerate:b eligible:b"
)
_KIND = {"decisions": "i", "correct": "i", "degenerate": "b", "all_decisions": "i"}


@once(keep=True)
def target_grid(t):
    rows = pr.target_occurrences(long_grid(t), TARGETS)
    frozen = pr.universe(long_rows(t), TARGETS).withColumn("in_universe", F.lit(True))
    return rows.join(frozen, ["scope", "pair_id"], "left").withColumn("in_universe", F.coalesce("in_universe", F.lit(False)))


PERSIST = """
SELECT model_id, head, count(*) AS folds_in_scope, count(g) AS occurrences, count(*) FILTER (NOT eligible) AS excluded_small,
  count(*) FILTER (eligible AND degenerate) AS excluded_degenerate, median(g) AS median_gap, median(abs(g)) AS median_abs_gap,
  count(*) FILTER (g > 0) / nullif(CAST(count(g) AS DOUBLE), 0) AS positive_fraction, count(*) FILTER (g < 0) / nullif(CAST(count(g) AS DOUBLE), 0) AS negative_fraction,
  count(*) FILTER (g = 0) AS zero_count,
  greatest(count(*) FILTER (g > 0), count(*) FILTER (g < 0)) / nullif(CAST(count(g) AS DOUBLE), 0) AS same_sign_fraction,
  CASE WHEN count(g) >= 9 THEN 7 / 9.0 WHEN count(g) > 0 THEN 0.8 END AS same_sign_required,
  coalesce(count(g) >= {minimum} AND median(abs(g)) >= 0.08
    AND greatest(count(*) FILTER (g > 0), count(*) FILTER (g < 0)) / nullif(CAST(count(g) AS DOUBLE), 0) >= CASE WHEN count(g) >= 9 THEN 7 / 9.0 ELSE 0.8 END - 1e-9, false) AS persistent
FROM (SELECT *, CASE WHEN eligible AND NOT degenerate THEN corrected_gap END AS g FROM v_long) x GROUP BY 1, 2"""
PERSIST_COLS = (
    "model_id:s head:s folds_in_scope:i occurrences:i excluded_small:i excluded_degenerate:i median_gap:d median_abs_gap:d positive_fraction:d "
    "negative_fraction:d zero_count:i same_sign_fraction:d same_sign_required:d persistent:b"
)

QUERIES = [
    Query("d5_unordered_pairs", "pair_id:s agent_a:s agent_b:s", lambda t: pr.unordered_pairs(t.runs(), "model_id"), "SELECT * FROM v_pairs"),
    Query("d6_common_support", "pair_id:s common_tasks:i matched_runs:i",
          lambda t: pr.common_support(*folds(t)[:2]),
          "SELECT pair_id, count(*) AS common_tasks, sum(matched) AS matched_runs FROM v_common GROUP BY 1"),
    Query("b18_task_half", "instance_id:s half:s",
          lambda t: t.runs().select("instance_id").distinct().withColumn("half", pr.task_half("instance_id")),
          """SELECT instance_id, CASE WHEN right(sha256(instance_id), 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 'A' ELSE 'B' END AS half
             FROM (SELECT DISTINCT instance_id FROM v_runs) x"""),
    Query("e33_pairwise_metrics",
          "pair_id:s head:s agent_a:s agent_b:s n_common_tasks:i pi_train:d train_n:i eligible:b "
          + " ".join(f"{s}_{c}:{_KIND.get(c, 'd')}" for s in "ab" for c in pr.SIDE_COLUMNS)
          + " residual_gap_difference:d raw_gap_difference:d precision_difference:d prior_difference:d abs_gap_a:d abs_gap_b:d",
          pairwise, "SELECT * FROM v_pairwise"),
    Query("e33_pair_occurrences", "side:s partner:s n_common_tasks:i target_n:i target_r:i train_n:i train_r:i " + OCC_COLS, long_rows, "SELECT * FROM v_long"),
    Query("e34_occurrence_table", "scope:s threshold:d in_universe:b " + OCC_COLS, target_grid, "SELECT * FROM v_target_grid"),
    Query("e35_occurrence_stats", "scope:s threshold:d " + STAT_COLS,
          lambda t: pr.occurrence_stats(target_grid(t).where(F.col("in_universe") & (F.col("decisions") >= fixed.MIN_DECISIONS)), ["scope", "threshold"]),
          f"SELECT scope, threshold, {_STATS} FROM v_target_grid WHERE in_universe AND decisions >= 20 GROUP BY 1, 2"),
    Query("e36_persistence_table", PERSIST_COLS, lambda t: pr.persistence_table(long_rows(t)), PERSIST.format(minimum=7)),
    Query("e36_persistence_table_few_folds", PERSIST_COLS, lambda t: pr.persistence_table(long_rows(t), 3), PERSIST.format(minimum=3)),
    Query("e37_task_half_results", "scope:s half:s counted:b " + OCC_COLS,
          lambda t: pr.target_occurrences(long_halves(t), TARGETS).withColumn(
              "counted", (F.col("decisions") >= fixed.HALF_MIN_DECISIONS) & ~F.col("degenerate")),
          """SELECT t.scope, l.*, decisions >= 10 AND NOT degenerate AS counted FROM v_long_half l
             JOIN v_target_list t ON t.model_id = l.model_id AND t.head = l.head"""),
    Query("e38_agent_prior_summary", "model_id:s folds:i mean_prior:d min_prior:d max_prior:d degenerate_in_any:b",
          lambda t: pr.agent_prior_summary(long_rows(t)),
          """SELECT model_id, count(*) AS folds, avg(pi_target) AS mean_prior, min(pi_target) AS min_prior, max(pi_target) AS max_prior,
               bool_or(pi_target IN (0, 1)) AS degenerate_in_any FROM v_pprior GROUP BY 1"""),
    Query("e46_agent_gap_ranking", "head:s model_id:s occurrences:i median_abs_gap:d position:i difference:d",
          lambda t: pr.gap_ranking(long_rows(t)),
          """SELECT head, model_id, count(g) AS occurrences, median(abs(g)) AS median_abs_gap,
               row_number() OVER (PARTITION BY head ORDER BY median(abs(g)) DESC NULLS LAST, model_id) AS position,
               CASE WHEN count(g) > 0 THEN 0.0 END AS difference
             FROM (SELECT *, CASE WHEN eligible AND NOT degenerate THEN corrected_gap END AS g FROM v_long) x GROUP BY 1, 2"""),
    Query("w2_rank_within_head", "head:s model_id:s position:i",
          lambda t: pr.gap_ranking(long_rows(t)).select("head", "model_id", "position"),
          """WITH m AS (SELECT head, model_id, median(abs(corrected_gap)) FILTER (eligible AND NOT degenerate) AS v FROM v_long GROUP BY 1, 2)
             SELECT a.head, a.model_id, 1 + count(b.model_id) AS position FROM m a LEFT JOIN m b ON b.head = a.head AND b.model_id <> a.model_id
               AND (coalesce(b.v, -1) > coalesce(a.v, -1) OR (coalesce(b.v, -1) = coalesce(a.v, -1) AND b.model_id < a.model_id)) GROUP BY 1, 2"""),
    Query("e48_secondary_correlations",
          "head:s eligible_folds:i median_raw:d median_residual:d folds_reduced:i median_precision_difference:d max_precision_difference:d rho_residual:d rho_raw:d",
          lambda t: pr.secondary_correlations(pairwise(t)),
          f"""WITH e AS (SELECT * FROM v_pairwise WHERE eligible),
             x AS ({o.spearman('e', 'head', 'prior_difference', 'residual_gap_difference', 'rho_residual')}),
             y AS ({o.spearman('e', 'head', 'prior_difference', 'raw_gap_difference', 'rho_raw')})
             SELECT b.*, x.rho_residual, y.rho_raw FROM (
               SELECT head, count(*) AS eligible_folds, median(raw_gap_difference) AS median_raw, median(residual_gap_difference) AS median_residual,
                 count(*) FILTER (residual_gap_difference < raw_gap_difference) AS folds_reduced, median(precision_difference) AS median_precision_difference,
                 max(precision_difference) AS max_precision_difference FROM e GROUP BY 1) b
             LEFT JOIN x ON x.head = b.head LEFT JOIN y ON y.head = b.head"""),
    Query("w4_jackknife", "scope:s left_out:s median_gap:d median_abs_gap:d sign_preserved:b",
          lambda t: pr.jackknife(eligible_targets(t), ["scope"]),
          """SELECT a.scope, a.pair_id AS left_out, median(b.corrected_gap) AS median_gap, median(abs(b.corrected_gap)) AS median_abs_gap,
               sign(median(b.corrected_gap)) = sign((SELECT median(corrected_gap) FROM v_universe u WHERE u.scope = a.scope)) AS sign_preserved
             FROM v_universe a LEFT JOIN v_universe b ON b.scope = a.scope AND b.pair_id <> a.pair_id GROUP BY 1, 2"""),
    Query("w4_jackknife_all_cells", "model_id:s head:s left_out:s median_gap:d median_abs_gap:d",
          lambda t: pr.jackknife(long_rows(t), ["model_id", "head"]),
          """SELECT a.model_id, a.head, a.pair_id AS left_out, median(b.corrected_gap) AS median_gap, median(abs(b.corrected_gap)) AS median_abs_gap
             FROM (SELECT * FROM v_long WHERE corrected_gap IS NOT NULL) a LEFT JOIN (SELECT * FROM v_long WHERE corrected_gap IS NOT NULL) b
               ON b.model_id = a.model_id AND b.head = a.head AND b.pair_id <> a.pair_id GROUP BY 1, 2, 3"""),
    Query("k8_universe_audit", "scope:s frozen_occurrences:i literal_occurrences:i extra_occurrences:i frozen_median:d literal_median:d",
          lambda t: pr.universe_audit(long_rows(t), TARGETS),
          """SELECT scope, count(*) FILTER (eligible AND NOT degenerate) AS frozen_occurrences, count(*) FILTER (decisions >= 20 AND NOT degenerate) AS literal_occurrences,
               count(*) FILTER (decisions >= 20 AND NOT degenerate AND NOT eligible) AS extra_occurrences,
               median(corrected_gap) FILTER (eligible AND NOT degenerate) AS frozen_median, median(corrected_gap) FILTER (decisions >= 20 AND NOT degenerate) AS literal_median
             FROM v_targets GROUP BY 1"""),
]
