"""SQL side of the checks: shared common table expressions and scalar snippets.

A statement names the views it needs (all start with ``v_``); ``statement`` adds exactly those,
dependencies first. The SQL follows another route than the Spark plan wherever there is one, for
instance ordered windows where the plan uses conditional aggregates.
"""

from __future__ import annotations

import re

from stopwise import fixed
from stopwise.sources import tables

VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    if name in VIEWS:
        raise ValueError(f"duplicate view {name}")
    VIEWS[name] = sql


def statement(sql: str) -> str:
    order: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bv_\w+", text)):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    if not order:
        return sql
    return "WITH " + ",\n".join(f"{n} AS (\n{VIEWS[n]}\n)" for n in order) + "\n" + sql


# ---- scalar snippets -------------------------------------------------------------------------

def div(n: str, d: str) -> str:
    return f"(CAST({n} AS DOUBLE) / nullif(CAST({d} AS DOUBLE), 0))"


def logit(p: str) -> str:
    c = f"least(greatest({p}, 1e-12), CAST(1.0 - 1e-12 AS DOUBLE))"
    return f"ln({c} / (1 - {c}))"


def sigmoid(z: str) -> str:
    return f"(CASE WHEN {z} >= 0 THEN 1 / (1 + exp(-({z}))) ELSE exp({z}) / (1 + exp({z})) END)"


def log_odds(p: str) -> str:
    return (
        f"(CASE WHEN {p} <= 0 THEN CAST('-Infinity' AS DOUBLE) WHEN {p} >= 1 THEN CAST('Infinity' AS DOUBLE) "
        f"ELSE ln({p} / (1 - {p})) END)"
    )


def log_ratio(target: str, train: str) -> str:
    return f"({log_odds(target)} - {log_odds(train)})"


def shift(p: str, head: str, log_r: str) -> str:
    z = f"({logit(p)} + (CASE WHEN {head} = 'success' THEN 1.0 ELSE -1.0 END) * {log_r})"
    return sigmoid(z)


def degenerate(t: str, r: str) -> str:
    return f"({t} IN (0.0, 1.0) OR {r} IN (0.0, 1.0))"


def wilson_low(k: str, n: str) -> str:
    return _wilson(k, n, "-")


def wilson_high(k: str, n: str) -> str:
    return _wilson(k, n, "+")


def _wilson(k: str, n: str, op: str) -> str:
    z = repr(fixed.WILSON_Z)
    p = f"(CAST({k} AS DOUBLE) / {n})"
    bound = (
        f"(({p} + {z}*{z}/(2.0*{n})) {op} {z} * sqrt({p}*(1-{p})/{n} + {z}*{z}/(4.0*{n}*{n})))"
        f" / (1 + {z}*{z}/{n})"
    )
    clipped = f"greatest(0.0, {bound})" if op == "-" else f"least(1.0, {bound})"
    return f"(CASE WHEN {n} > 0 THEN {clipped} END)"


def robust(gap: str, lo: str, hi: str) -> str:
    return (
        f"coalesce(abs({gap}) >= {fixed.ROBUST_GAP} AND (({lo} > 0 AND {gap} > 0) OR ({hi} < 0 AND {gap} < 0)), false)"
    )


def draw(parts: str, n: str) -> str:
    """Uniform index below n from the first eight hex digits of an md5."""
    return f"(CAST('0x' || substr(md5(concat_ws('|', {parts})), 1, 8) AS BIGINT) % {n})"


def spearman(source: str, keys: str, x: str, y: str, name: str = "rho") -> str:
    """Average ranks, then Pearson's formula on the ranks; one subquery per key group."""
    part = f"PARTITION BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    sep = "," if keys else "PARTITION BY"
    group = f"GROUP BY {keys}" if keys else ""
    return f"""
SELECT {lead}count(*) AS n_{name},
  CASE WHEN count(*) >= 2 THEN
    (count(*)*sum(rx*ry) - sum(rx)*sum(ry))
    / nullif(sqrt((count(*)*sum(rx*rx) - sum(rx)*sum(rx)) * (count(*)*sum(ry*ry) - sum(ry)*sum(ry))), 0) END AS {name}
FROM (
  SELECT {lead}
    rank() OVER ({part} ORDER BY x) + (count(*) OVER ({part}{sep} x) - 1) / 2.0 AS rx,
    rank() OVER ({part} ORDER BY y) + (count(*) OVER ({part}{sep} y) - 1) / 2.0 AS ry
  FROM (SELECT {lead}round({x}, 12) AS x, round({y}, 12) AS y FROM {source}
        WHERE {x} IS NOT NULL AND {y} IS NOT NULL AND NOT isnan({x}) AND NOT isnan({y})) a
) b {group}"""


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def pick(values, index: str) -> str:
    return f"([{quoted(values)}])[CAST({index} AS BIGINT) + 1]"


# ---- views of the data model -----------------------------------------------------------------

view("v_runs", """
SELECT o_orderkey AS traj_id, 'task-' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') AS instance_id,
  o_orderpriority AS model_id,
  CASE WHEN o_orderstatus = 'F' THEN 1
       WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 6 >= CAST(substr(o_orderpriority, 1, 1) AS INT) THEN 1 ELSE 0 END
       ELSE CASE WHEN o_orderkey % 4 <> 0 THEN 1 ELSE 0 END END AS resolved
FROM orders""")

view("v_lines", """
SELECT l_orderkey AS traj_id, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS prefix_step_idx,
  l_quantity AS quantity, l_discount AS discount, l_tax AS min_tax, l_returnflag = 'A' AS test_pass,
  l_returnflag = 'R' AS test_fail, l_linestatus = 'O' AND l_tax >= 0.07 AS traceback
FROM lineitem""")

view("v_preds", """
SELECT traj_id, prefix_step_idx, max(prefix_step_idx) OVER (PARTITION BY traj_id) AS n_steps_total,
  round(0.5 + quantity / 100, 6) AS p_success, round(0.5 + 4.9 * discount, 6) AS p_failure
FROM v_lines""")

view("v_preds_shifted", """
SELECT traj_id, prefix_step_idx, n_steps_total,
  CASE WHEN traj_id % 1000 = 0 THEN p_success - 1e-9 ELSE p_success END AS p_success, p_failure
FROM v_preds""")

view("v_steps", f"""
SELECT traj_id, prefix_step_idx + 1 AS step_idx, {pick(tables.ACTIONS, 'prefix_step_idx % 7')} AS action_text,
  CASE WHEN discount >= 0.09 THEN 'tee out.log' END AS tool_args_text, min_tax = 0 AS test_kind,
  test_pass, test_fail, traceback
FROM v_lines""")

view("v_events", f"""
SELECT traj_id, step_idx,
  regexp_matches(coalesce(action_text, '') || chr(10) || coalesce(tool_args_text, ''), '{fixed.EDIT_PATTERN.replace("'", "''")}') AS is_edit,
  test_kind OR regexp_matches(action_text, '{fixed.TEST_PATTERN}') AS is_test,
  test_pass AS is_test_pass, test_fail AS is_test_fail, traceback AS is_error,
  contains(action_text, '{fixed.SUBMIT_MARKER}') AS is_submit
FROM v_steps""")

view("v_thresholds", "SELECT CAST(t AS DOUBLE) AS threshold FROM (VALUES (0.9), (0.925), (0.95), (0.975)) x(t)")

_HITS = """
SELECT threshold, traj_id, head, prefix_step_idx, score FROM (
  SELECT threshold, traj_id, prefix_step_idx, 'success' AS head, p_success AS score FROM {preds}, v_thresholds
  UNION ALL SELECT threshold, traj_id, prefix_step_idx, 'failure', p_failure FROM {preds}, v_thresholds) u
WHERE score >= threshold
QUALIFY row_number() OVER (PARTITION BY threshold, traj_id ORDER BY prefix_step_idx, score DESC, head DESC) = 1"""

_GRID = """
SELECT r.traj_id, r.instance_id, r.model_id, r.resolved, t.threshold,
  coalesce(c.n, 0) AS n_prefix_rows, coalesce(c.total, 0) AS n_steps_total,
  f.head IS NOT NULL AS decided, coalesce(f.head, 'undecided') AS decision,
  coalesce(f.prefix_step_idx, -1) AS decision_step, f.score AS decision_score,
  coalesce(greatest(c.total - f.prefix_step_idx, 0), 0) AS saved_steps
FROM v_runs r CROSS JOIN v_thresholds t
LEFT JOIN (SELECT traj_id, count(*) AS n, max(n_steps_total) AS total FROM {preds} GROUP BY 1) c ON c.traj_id = r.traj_id
LEFT JOIN {first} f ON f.traj_id = r.traj_id AND f.threshold = t.threshold"""

view("v_first", _HITS.format(preds="v_preds"))
view("v_grid", _GRID.format(preds="v_preds", first="v_first"))
view("v_first_shifted", _HITS.format(preds="v_preds_shifted"))
view("v_grid_shifted", _GRID.format(preds="v_preds_shifted", first="v_first_shifted"))
view("v_dec", "SELECT * EXCLUDE (threshold) FROM v_grid WHERE threshold = 0.95")

view("v_outcome_class", """
SELECT *, CASE WHEN NOT decided THEN 'NO_STOP'
    WHEN decision = 'success' AND resolved = 1 THEN 'CORRECT_SUCCESS' WHEN decision = 'success' THEN 'FALSE_SUCCESS'
    WHEN resolved = 0 THEN 'CORRECT_FAILURE' ELSE 'FALSE_FAILURE' END AS outcome_class,
  CASE WHEN decided THEN CASE WHEN (decision = 'success') = (resolved = 1) THEN 1 ELSE 0 END END AS correct
FROM v_dec""")

view("v_tail", """
SELECT d.traj_id, count(e.step_idx) AS post_steps,
  count(e.step_idx) > 0 AS post_activity,
  coalesce(bool_or(is_edit), false) AS post_edit, coalesce(bool_or(is_test), false) AS post_test,
  coalesce(bool_or(is_test_pass), false) AS post_test_pass, coalesce(bool_or(is_test_fail), false) AS post_test_fail,
  coalesce(bool_or(is_error), false) AS post_error, coalesce(bool_or(is_submit), false) AS post_submission,
  count(*) FILTER (is_edit) AS post_edit_count, count(*) FILTER (is_test) AS post_test_count,
  CASE WHEN count(e.step_idx) = 0 THEN 'NOT_OBSERVABLE' WHEN bool_or(is_test_pass) THEN 'TRUE' ELSE 'FALSE' END AS first_test_pass_after_stop
FROM v_dec d LEFT JOIN v_events e ON e.traj_id = d.traj_id AND e.step_idx > d.decision_step
WHERE d.decided GROUP BY d.traj_id""")

view("v_out", f"""
SELECT o.*, t.* EXCLUDE (traj_id),
  CASE WHEN decided THEN {div('decision_step', 'n_steps_total')} END AS decision_fraction,
  CASE WHEN decided AND n_steps_total > 0 THEN CAST(least(floor(decision_step * 4.0 / n_steps_total), 3) AS INT) END AS fraction_bin,
  post_edit AND (post_test_pass OR post_submission) AS ff_signature,
  post_test_fail OR post_error AS fs_signature
FROM v_outcome_class o LEFT JOIN v_tail t ON t.traj_id = o.traj_id""")

view("v_prior", f"""
SELECT m.model_id, m.n, m.r, m.n * 0 + (t.n - m.n) AS train_n, {div('m.r', 'm.n')} AS test_prior,
  {div('t.r - m.r', 't.n - m.n')} AS train_prior, {div('m.r', 'm.n')} - {div('t.r - m.r', 't.n - m.n')} AS prior_shift
FROM (SELECT model_id, count(*) AS n, sum(resolved) AS r FROM v_runs GROUP BY 1) m,
     (SELECT count(*) AS n, sum(resolved) AS r FROM v_runs) t""")

view("v_coef", f"""
SELECT *, {log_ratio('test_prior', 'train_prior')} AS log_r, {degenerate('test_prior', 'train_prior')} AS degenerate FROM v_prior""")

view("v_cor", f"""
SELECT o.*, c.log_r, c.degenerate, {shift('o.decision_score', 'o.decision', 'c.log_r')} AS p_corrected
FROM v_outcome_class o JOIN v_coef c ON c.model_id = o.model_id WHERE o.decided""")

view("v_heads", "SELECT 'success' AS head UNION ALL SELECT 'failure'")

view("v_gap", f"""
SELECT p.model_id, h.head, p.degenerate, p.test_prior, p.train_prior, p.prior_shift, count(c.traj_id) AS decisions, coalesce(sum(c.correct), 0) AS correct,
  avg(c.correct) AS precision, avg(c.decision_score) AS mean_raw_score, avg(c.p_corrected) AS mean_corrected_score,
  avg(c.decision_score) - avg(c.correct) AS raw_gap, avg(c.p_corrected) - avg(c.correct) AS corrected_gap,
  count(DISTINCT c.instance_id) AS distinct_tasks
FROM v_coef p CROSS JOIN v_heads h LEFT JOIN v_cor c ON c.model_id = p.model_id AND c.decision = h.head
GROUP BY ALL""")

view("v_rel", """
SELECT model_id, head, count(*) FILTER (decision = head) AS n,
  count(*) FILTER (decision = head AND correct = 1) AS correct, count(*) FILTER (decision = head AND correct = 0) AS wrong,
  avg(correct) FILTER (decision = head) AS precision, 1 - avg(correct) FILTER (decision = head) AS error
FROM v_outcome_class, v_heads GROUP BY 1, 2""")
