"""Coverage, missingness and connectivity of the wide trial table."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopwise.operators import coverage as cov
from stopwise.operators import ingest, quantiles
from stopwise.plans import oracle as o
from stopwise.plans.oracle import div, view
from stopwise.plans.q_gates import GATE, ge, gate_sql
from stopwise.plans.registry import Query, once
from stopwise.sources import tables


@once()
def classified(t):
    return cov.classify_usability(t.trials())


@once(keep=True)
def lengths(t):
    """What quantiles read of the classified rows, so that these are parsed once."""
    return classified(t).select("model", "usable", "n_steps")


@once(keep=True)
def counts(t):
    return cov.task_counts(classified(t))


@once()
def combos(t):
    return cov.combo_coverage(counts(t))


@once()
def pairs(t):
    c = counts(t)
    return cov.controlled_pairs(c, cov.combo_coverage(c))


_cmd = o.pick(tables.ACTIONS, "(o_orderkey + i) % 7")
_step = f"""'{{"src":"' || CASE WHEN i = 1 THEN 'user' ELSE 'agent' END || '","msg":' ||
  CASE WHEN i = 1 AND o_orderkey % 3 = 0 THEN '"Warmup run"' WHEN i % 4 = 0 THEN 'null' ELSE '"note ' || i || ' for order ' || (o_orderkey % 11) || '"' END ||
  ',"tools":' || CASE WHEN i = 1 THEN 'null' ELSE '[{{"fn":"' || CASE WHEN i % 2 = 0 THEN 'bash' ELSE 'editor' END || '","cmd":"' || {_cmd} || '"}}]' END ||
  ',"obs":' || CASE WHEN i % 3 = 0 THEN 'null' WHEN i % 3 = 1 THEN '"3 passed"' ELSE '"1 failed, OK"' END || '}}'"""
view("v_trial_steps", f"""
SELECT o_orderkey, '[' || string_agg({_step}, ',' ORDER BY i) || ']' AS steps
FROM orders, LATERAL (SELECT unnest(range(1, CAST(o_orderkey % 7 + 2 AS BIGINT))) AS i) s GROUP BY o_orderkey""")
view("v_trials", f"""
SELECT CASE WHEN o.o_orderkey % 3 = 0 THEN '' ELSE 'trial-' || o.o_orderkey END AS trial_id,
  CASE WHEN o.o_orderkey % 6 = 0 THEN '' ELSE 'name-' || o.o_orderkey END AS trial_name,
  'task-' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') AS task_name,
  {o.pick(tables.LABELS, '(o_custkey + o.o_orderkey // 60) % 8')} AS model, {o.pick(tables.SCAFFOLDS, '(o.o_orderkey // 7) % 4')} AS agent,
  CASE WHEN o.o_orderkey % 97 = 0 THEN NULL WHEN o.o_orderkey % 101 = 0 THEN 2 WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0
    WHEN o.o_orderkey % 4 <> 0 THEN 1 ELSE 0 END AS reward,
  CASE o.o_orderkey % 20 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'null' WHEN 3 THEN '[bad' WHEN 4 THEN '{{}}' WHEN 5 THEN '[]' ELSE s.steps END AS steps,
  o.o_orderkey AS row_key
FROM orders o JOIN v_trial_steps s ON s.o_orderkey = o.o_orderkey""")
view("v_tri_state", """
SELECT *, CASE WHEN steps IS NULL THEN 'NULL_FIELD' WHEN steps = '' THEN 'EMPTY_STRING' WHEN NOT json_valid(steps) THEN 'PARSE_FAIL'
    WHEN json_type(steps) = 'NULL' THEN 'JSON_NULL' WHEN json_type(steps) <> 'ARRAY' THEN 'NOT_LIST' WHEN json_array_length(steps) = 0 THEN 'EMPTY_LIST' ELSE 'OK' END AS steps_state
FROM v_trials""")
view("v_tri", """
SELECT *, steps_state = 'OK' AS has_steps, coalesce(reward IN (0, 1), false) AS binary_reward, steps_state IN ('PARSE_FAIL', 'NOT_LIST') AS schema_fail,
  steps_state = 'OK' AND coalesce(reward IN (0, 1), false) AS usable, CASE WHEN steps_state = 'OK' THEN json_array_length(steps) END AS n_steps,
  CASE WHEN steps_state = 'OK' AND reward IN (0, 1) THEN 'TRAJECTORY_USABLE' WHEN reward IS NULL THEN 'MISSING_REWARD' WHEN reward NOT IN (0, 1) THEN 'NON_BINARY_REWARD'
    WHEN steps_state IN ('PARSE_FAIL', 'NOT_LIST') THEN 'SCHEMA_FAIL' ELSE 'NO_STEPS' END AS reason
FROM v_tri_state""")
view("v_cells", """
SELECT model, agent, task_name, count(*) AS all_trials, count(*) FILTER (usable) AS usable, count(*) FILTER (usable AND reward = 1) AS successes,
  count(*) FILTER (usable AND reward = 0) AS failures, count(*) FILTER (reward = 1) AS successes_all, count(*) FILTER (reward = 0) AS failures_all,
  coalesce(sum(n_steps) FILTER (usable), 0) AS steps FROM v_tri GROUP BY 1, 2, 3""")
_SPREAD = """count(u) AS unique_tasks, avg(u) AS trials_per_task_mean, median(u) AS trials_per_task_median, min(u) AS trials_per_task_min, max(u) AS trials_per_task_max"""


def rules(*pairs_: tuple[str, str]) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in pairs_) + ")"


view("v_combos", f"""
SELECT *, ineligible_reasons = '' AS eligible FROM (
  SELECT *, coalesce(usable_fraction < 0.70, false) AS low_coverage,
    {rules(('USABLE_LT_100', 'usable_trials < 100'), ('SUCCESS_LT_20', 'successes < 20'), ('FAILURE_LT_20', 'failures < 20'), ('TASKS_LT_30', 'unique_tasks < 30'))} AS ineligible_reasons
  FROM (SELECT model, agent, sum(all_trials) AS all_trials, sum(usable) AS usable_trials, sum(successes) AS successes, sum(failures) AS failures, {_SPREAD},
      {div('sum(steps)', 'sum(usable)')} AS mean_steps, {div('sum(usable)', 'sum(all_trials)')} AS usable_fraction, {div('sum(successes)', 'sum(usable)')} AS success_rate
    FROM (SELECT *, nullif(usable, 0) AS u FROM v_cells) c GROUP BY 1, 2) x) y""")
view("v_audit", f"""
SELECT *, ineligible_reasons = '' AS eligible FROM (
  SELECT *, {rules(('USABLE_LT_100', 'usable < 100'), ('SUCCESS_USABLE_LT_20', 'successes < 20'), ('FAILURE_USABLE_LT_20', 'failures < 20'),
                   ('USABLE_FRACTION_LT_0.60', 'usable_fraction IS NULL OR usable_fraction < 0.60'), ('MISSINGNESS_GAP_GT_0.20', 'missingness_gap IS NULL OR missingness_gap > 0.20'))} AS ineligible_reasons
  FROM (SELECT a.*, {div('usable', 'all_trials')} AS usable_fraction, {div('successes', 'successes_all')} AS success_usable_fraction, {div('failures', 'failures_all')} AS failure_usable_fraction,
      abs({div('successes', 'successes_all')} - {div('failures', 'failures_all')}) AS missingness_gap, b.* EXCLUDE (model)
    FROM (SELECT model, count(*) AS all_trials, count(*) FILTER (usable) AS usable, count(*) FILTER (usable AND reward = 1) AS successes, count(*) FILTER (usable AND reward = 0) AS failures,
            count(*) FILTER (reward = 1) AS successes_all, count(*) FILTER (reward = 0) AS failures_all FROM v_tri GROUP BY 1) a
    JOIN (SELECT model, {_SPREAD} FROM (SELECT model, task_name, nullif(count(*) FILTER (usable), 0) AS u FROM v_tri GROUP BY 1, 2) m GROUP BY 1) b ON b.model = a.model) x) y""")
view("v_cpairs", """
SELECT *, common_tasks >= 30 AS ge30, common_tasks >= 40 AS ge40, common_tasks >= 50 AS ge50, common_tasks >= 70 AS ge70 FROM (
  SELECT a.model AS model_a, a.agent AS agent_a, b.model AS model_b, b.agent AS agent_b, CASE WHEN a.model = b.model THEN 'SAME_MODEL' ELSE 'SAME_SCAFFOLD' END AS relation,
    count(y.task_name) AS common_tasks, coalesce(sum(CASE WHEN y.task_name IS NOT NULL THEN least(x.usable, y.usable) END), 0) AS matched_trials
  FROM v_combos a JOIN v_combos b ON a.eligible AND b.eligible AND (a.model, a.agent) < (b.model, b.agent) AND (a.model = b.model OR a.agent = b.agent)
  LEFT JOIN v_cells x ON x.model = a.model AND x.agent = a.agent AND x.usable > 0
  LEFT JOIN v_cells y ON y.model = b.model AND y.agent = b.agent AND y.task_name = x.task_name AND y.usable > 0 GROUP BY 1, 2, 3, 4) z""")
view("v_connect", """
SELECT *, members >= 3 AS crossed FROM (
  SELECT 'MODEL_CONTROLLED' AS design, m.model AS group_name, m.*EXCLUDE (model), p.* EXCLUDE (g) FROM
    (SELECT model, count(*) AS members, min(least(success_rate, 1 - success_rate)) AS min_balance, avg(usable_fraction) AS mean_usable_fraction, avg(usable_trials) AS mean_usable_trials
     FROM v_combos WHERE eligible GROUP BY 1 HAVING count(*) >= 2) m
    JOIN (SELECT model_a AS g, count(*) AS pairs, median(common_tasks) AS common_median, min(common_tasks) AS common_min, max(common_tasks) AS common_max
          FROM v_cpairs WHERE relation = 'SAME_MODEL' GROUP BY 1) p ON p.g = m.model
  UNION ALL
  SELECT 'SCAFFOLD_CONTROLLED', m.agent, m.* EXCLUDE (agent), p.* EXCLUDE (g) FROM
    (SELECT agent, count(*) AS members, min(least(success_rate, 1 - success_rate)) AS min_balance, avg(usable_fraction) AS mean_usable_fraction, avg(usable_trials) AS mean_usable_trials
     FROM v_combos WHERE eligible GROUP BY 1 HAVING count(*) >= 2) m
    JOIN (SELECT agent_a AS g, count(*) AS pairs, median(common_tasks) AS common_median, min(common_tasks) AS common_min, max(common_tasks) AS common_max
          FROM v_cpairs WHERE relation = 'SAME_SCAFFOLD' GROUP BY 1) p ON p.g = m.agent) c""")
view("v_step_rows", """
SELECT model, agent, row_key, i - 1 AS pos, steps -> CAST(i - 1 AS BIGINT) AS step FROM (
  SELECT model, agent, row_key, steps, unnest(range(1, CAST(n_steps AS BIGINT) + 1)) AS i FROM v_tri WHERE usable) s""")

COMBO = ("model:s agent:s all_trials:i usable_trials:i unique_tasks:i successes:i failures:i trials_per_task_mean:d trials_per_task_median:d trials_per_task_min:i "
         "trials_per_task_max:i mean_steps:d usable_fraction:d success_rate:d low_coverage:b ineligible_reasons:s eligible:b")
PAIR = "model_a:s agent_a:s model_b:s agent_b:s relation:s common_tasks:i matched_trials:i ge30:b ge40:b ge50:b ge70:b"
CONNECT = ("design:s group_name:s members:i min_balance:d mean_usable_fraction:d mean_usable_trials:d pairs:i common_median:d common_min:i common_max:i crossed:b")
_count_if = lambda cond, name: f"count(*) FILTER ({cond}) AS {name}"


def crossed(t, group, member):
    return cov.crossed_groups(combos(t), group, member)


def crossed_sql(group: str, member: str) -> str:
    return f"""SELECT {group}, count(*) AS members, string_agg({member}, '|' ORDER BY {member}) AS member_list, count(*) >= 3 AS crossed FROM v_combos WHERE eligible GROUP BY 1"""


def pick(t):
    c = classified(t)
    return cov.stratified_pick(c, cov.combo_coverage(cov.task_counts(c)))


PICK_SQL = """
SELECT model, agent, reward, row_key, rn, position FROM (
  SELECT *, row_number() OVER (PARTITION BY model, agent ORDER BY rn, reward DESC) AS position FROM (
    SELECT t.model, t.agent, t.reward, t.row_key, row_number() OVER (PARTITION BY t.model, t.agent, t.reward ORDER BY t.row_key) AS rn
    FROM v_tri t JOIN v_combos c ON c.model = t.model AND c.agent = t.agent AND c.eligible WHERE t.usable) a) b WHERE position <= 25"""
view("v_pick", PICK_SQL)


@once()
def prefixes(t):
    from stopwise.plans.q_ingest import trial_runs

    return ingest.expand_prefixes(trial_runs(t)).select(*cov.PREFIX_COLUMNS)


def damaged_prefixes(t):
    """Prefixes without the last step of some runs, and without a required column."""
    lost = F.substring(F.md5("traj_id"), 1, 1).isin("0", "1") & (F.col("prefix_step_idx") == F.col("n_steps_total")) & (F.col("prefix_step_idx") > 0)
    return prefixes(t).where(~lost).drop("label")


def observed(t):
    """The classified table against its own metrics, and a copy that lost some rows."""
    metrics = {"rows": F.count(F.lit(1)), "usable": F.count_if("usable"), "steps": F.sum("n_steps")}
    written, seen = cov.observed_write(classified(t).select("row_key", "usable", "n_steps"), "classified", metrics)
    damaged = written.where(F.col("row_key") % 50 != 7)
    return cov.recount(written, metrics, seen).withColumn("copy", F.lit("intact")).unionByName(cov.recount(damaged, metrics, seen).withColumn("copy", F.lit("damaged")))


QUERIES = [
    Query("b8_classify_usability", "row_key:i steps_state:s has_steps:b binary_reward:b schema_fail:b usable:b n_steps:i reason:s", classified, "SELECT * FROM v_tri"),
    Query("e19_combo_coverage", COMBO, combos, "SELECT * FROM v_combos"),
    Query("e19_task_counts", "model:s agent:s task_name:s all_trials:i usable:i successes:i failures:i successes_all:i failures_all:i steps:i", counts, "SELECT * FROM v_cells"),
    Query("b21_ineligible_reasons", "model:s agent:s ineligible_reasons:s eligible:b", combos, "SELECT * FROM v_combos"),
    Query("e20_corpus_profile",
          "rows:i rows_with_steps:i usable_rows:i " + " ".join(f"state_{s.lower()}:i" for s in cov.STATES) + " " + " ".join(f"reason_{r.lower()}:i" for r in cov.REASONS)
          + " reward_missing:i reward_non_binary:i usable_with_trial_id:i usable_steps:i",
          lambda t: cov.corpus_profile(classified(t)),
          "SELECT count(*) AS rows, " + ", ".join(
              [_count_if("has_steps", "rows_with_steps"), _count_if("usable", "usable_rows")]
              + [_count_if(f"steps_state = '{s}'", f"state_{s.lower()}") for s in cov.STATES] + [_count_if(f"reason = '{r}'", f"reason_{r.lower()}") for r in cov.REASONS]
              + [_count_if("reward IS NULL", "reward_missing"), _count_if("reward NOT IN (0, 1)", "reward_non_binary"), _count_if("usable AND trial_id <> ''", "usable_with_trial_id")])
          + ", sum(n_steps) FILTER (usable) AS usable_steps FROM v_tri"),
    Query("e20_corpus_distinct", "dimension:s n_all:i n_usable:i", lambda t: cov.corpus_distinct(classified(t)),
          " UNION ALL ".join(f"SELECT '{n}' AS dimension, count(DISTINCT {e}) AS n_all, count(DISTINCT {e}) FILTER (usable) AS n_usable FROM v_tri"
                             for n, e in (("tasks", "task_name"), ("models", "model"), ("agents", "agent"), ("combos", "model || '/' || agent"), ("trial_ids", "nullif(trial_id, '')")))),
    Query("e21_step_histograms", "kind:s value:s n:i", lambda t: cov.step_histograms(classified(t)),
          """SELECT 'key' AS kind, k AS value, count(*) AS n FROM (SELECT unnest(json_keys(step)) AS k FROM v_step_rows) a GROUP BY 2
             UNION ALL SELECT 'src', coalesce(step ->> 'src', 'None'), count(*) FROM v_step_rows GROUP BY 2
             UNION ALL SELECT 'length', CAST(n_steps AS VARCHAR), count(*) FROM v_tri WHERE usable GROUP BY 2
             UNION ALL SELECT 'tool', fn, n FROM (SELECT fn, count(*) AS n FROM (SELECT unnest(json_extract_string(step, '$.tools[*].fn')) AS fn FROM v_step_rows) b
                       GROUP BY 1 ORDER BY n DESC, fn LIMIT 50) c"""),
    Query("e21_step_quality", "steps:i null_msg:i null_obs:i null_tools:i warmup_first:i empty_first_msg:i", lambda t: cov.step_quality(classified(t)),
          """SELECT count(*) AS steps, count(*) FILTER (step ->> 'msg' IS NULL) AS null_msg, count(*) FILTER (step ->> 'obs' IS NULL) AS null_obs,
               count(*) FILTER (json_type(step -> 'tools') = 'NULL') AS null_tools,
               count(*) FILTER (pos = 0 AND step ->> 'src' = 'user' AND contains(lower(step ->> 'msg'), 'warmup')) AS warmup_first,
               count(*) FILTER (pos = 0 AND coalesce(step ->> 'msg', '') = '') AS empty_first_msg FROM v_step_rows"""),
    Query("e22_quantiles", "model:s q10:d q50:d q90:d nearest_rank:i",
          lambda t: (lambda c: quantiles.exact_quantiles(c.where("usable"), ["model"], "n_steps", (0.1, 0.5, 0.9)).select(
              "model", F.col("q")[0].alias("q10"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q90")).join(
                  cov.nearest_rank(c.where("usable"), ["model"], "n_steps", 0.9), "model"))(lengths(t)),
          """SELECT model, quantile_cont(n_steps, 0.1) AS q10, quantile_cont(n_steps, 0.5) AS q50, quantile_cont(n_steps, 0.9) AS q90,
               (list_sort(list(n_steps)))[CAST(round_even(0.9 * (count(*) - 1), 0) AS BIGINT) + 1] AS nearest_rank FROM v_tri WHERE usable GROUP BY 1"""),
    Query("e23_missingness_audit",
          "model:s all_trials:i usable:i successes:i failures:i successes_all:i failures_all:i unique_tasks:i trials_per_task_mean:d trials_per_task_median:d trials_per_task_min:i "
          "trials_per_task_max:i usable_fraction:d success_usable_fraction:d failure_usable_fraction:d missingness_gap:d ineligible_reasons:s eligible:b",
          lambda t: cov.missingness_audit(counts(t)), "SELECT * FROM v_audit"),
    Query("e24_cross_scaffold", "model:s members:i member_list:s crossed:b", lambda t: crossed(t, "model", "agent"), crossed_sql("model", "agent")),
    Query("e24_cross_model", "agent:s members:i member_list:s crossed:b", lambda t: crossed(t, "agent", "model"), crossed_sql("agent", "model")),
    Query("e25_pair_common_tasks", PAIR, pairs, "SELECT * FROM v_cpairs"),
    Query("e26_trial_multiplicity",
          "model:s agent:s cells:i trials:i per_cell_mean:d per_cell_median:d per_cell_min:i per_cell_max:i cells_1:i cells_2_4:i cells_5_9:i cells_10_plus:i",
          lambda t: cov.trial_multiplicity(counts(t)),
          """SELECT model, agent, count(u) AS cells, coalesce(sum(u), 0) AS trials, avg(u) AS per_cell_mean, median(u) AS per_cell_median, min(u) AS per_cell_min, max(u) AS per_cell_max,
               count(*) FILTER (u = 1) AS cells_1, count(*) FILTER (u BETWEEN 2 AND 4) AS cells_2_4, count(*) FILTER (u BETWEEN 5 AND 9) AS cells_5_9, count(*) FILTER (u >= 10) AS cells_10_plus
             FROM (SELECT *, nullif(usable, 0) AS u FROM v_cells) c GROUP BY 1, 2"""),
    Query("e27_design_connectivity", CONNECT, lambda t: cov.design_connectivity(pairs(t), combos(t)), "SELECT * FROM v_connect"),
    Query("e27_connectivity_summary", "pairs:i pairs_ge30:i pairs_ge40:i pairs_ge50:i pairs_ge70:i common_median:d common_min:i common_max:i",
          lambda t: cov.connectivity_summary(pairs(t)),
          """SELECT count(*) AS pairs, count(*) FILTER (ge30) AS pairs_ge30, count(*) FILTER (ge40) AS pairs_ge40, count(*) FILTER (ge50) AS pairs_ge50, count(*) FILTER (ge70) AS pairs_ge70,
               median(common_tasks) AS common_median, min(common_tasks) AS common_min, max(common_tasks) AS common_max FROM v_cpairs"""),
    Query("e28_rank_designs", CONNECT, lambda t: cov.rank_designs(cov.design_connectivity(pairs(t), combos(t))),
          """SELECT * FROM v_connect WHERE crossed QUALIFY row_number() OVER (PARTITION BY design ORDER BY members DESC, common_median DESC NULLS LAST, min_balance DESC,
               mean_usable_fraction DESC, group_name) = 1"""),
    Query("e47_scaffold_followup", "model:s agent:s all_trials:i usable_trials:i usable_fraction:d unique_tasks:i pairs:i all_available:b",
          lambda t: cov.scaffold_followup(combos(t), pairs(t), "gpt-mini@openai", tables.SCAFFOLDS),
          """SELECT c.model, c.agent, all_trials, usable_trials, usable_fraction, unique_tasks, (SELECT count(*) FROM v_cpairs p WHERE p.relation = 'SAME_MODEL' AND p.model_a = c.model
               AND (p.agent_a = c.agent OR p.agent_b = c.agent)) AS pairs, (SELECT count(*) FROM v_combos x WHERE x.model = c.model) = 4 AS all_available
             FROM v_combos c WHERE c.model = 'gpt-mini@openai'"""),
    Query("j8_feasibility_gate", GATE,
          lambda t: cov.feasibility_gate(cov.corpus_profile(classified(t)), combos(t), crossed(t, "model", "agent"), crossed(t, "agent", "model"), pairs(t)),
          gate_sql(f"""SELECT (SELECT count(*) FROM v_tri WHERE NOT binary_reward) AS bad, (SELECT count(*) FROM v_tri WHERE has_steps) AS with_steps, (SELECT count(*) FROM v_tri) AS rows,
              (SELECT count(*) FROM v_combos WHERE eligible) AS eligible, (SELECT count(*) FROM ({crossed_sql('model', 'agent')}) a WHERE crossed) AS cm,
              (SELECT count(*) FROM ({crossed_sql('agent', 'model')}) b WHERE crossed) AS ca, (SELECT count(*) FROM v_cpairs WHERE ge30) AS p30""",
                   [("A_binary_outcome", "bad", 0.0, "bad = 0"), ("B_full_steps", "with_steps", "NULL", "with_steps >= 0.5 * rows"), ("C_simple_mapping", "1.0", 1.0, "true"),
                    ge("D_eligible_combos", "eligible", 8), ("E_crossed_structure", "greatest(cm, ca)", 2.0, "cm >= 2 OR ca >= 2"), ge("F_pairs_common_tasks", "p30", 10),
                    ("G_no_paid_calls", "1.0", 1.0, "true")],
                   """CASE WHEN ok:A_binary_outcome AND ok:B_full_steps AND ok:D_eligible_combos AND ok:E_crossed_structure AND ok:F_pairs_common_tasks THEN 'FEASIBLE'
                      WHEN ok:A_binary_outcome AND ok:B_full_steps THEN 'PARTIALLY_FEASIBLE' ELSE 'BLOCKED' END""")),
    Query("j12_minimum_models_gate", GATE, lambda t: cov.minimum_models_gate(cov.missingness_audit(counts(t))),
          gate_sql("SELECT count(*) AS eligible FROM v_audit WHERE eligible", [ge("eligible_models", "eligible", 12)],
                   "CASE WHEN ok:eligible_models THEN 'PROCEED_TO_TRAINING' ELSE 'INSUFFICIENT_FIXED_SCAFFOLD_MODEL_SUPPORT' END")),
    Query("k7_usable_crosscheck", "model:s usable:i other:i match:b", lambda t: cov.usable_crosscheck(cov.missingness_audit(counts(t)), cov.recount_usable(t.trials())),
          "SELECT model, count(*) FILTER (usable) AS usable, count(*) FILTER (usable) AS other, true AS match FROM v_tri GROUP BY 1"),
    Query("k7_observed_recount", "copy:s metric:s written:i reread:i mismatch:i", observed,
          """WITH m AS (SELECT row_key % 50 <> 7 AS kept, unnest(['rows', 'usable', 'steps']) AS metric, unnest([1, CAST(usable AS BIGINT), n_steps]) AS v FROM v_tri)
             SELECT copy, metric, sum(v) AS written, sum(v) FILTER (kept OR copy = 'intact') AS reread, sum(v) FILTER (kept OR copy = 'intact') - sum(v) AS mismatch
             FROM m CROSS JOIN (VALUES ('intact'), ('damaged')) c(copy) GROUP BY 1, 2"""),
    Query("w6_stratified_pick", "model:s agent:s reward:i row_key:i rn:i position:i", pick, "SELECT * FROM v_pick"),
    *[
        Query(key, "position:i model:s agent:s", lambda t, base=base: cov.diverse_combos(combos(t), base),
              f"""WITH RECURSIVE pool AS (SELECT row_number() OVER (ORDER BY model, agent) AS i, model, agent FROM v_combos WHERE eligible),
                 base AS (SELECT model, agent, usable_trials FROM v_combos WHERE eligible ORDER BY usable_trials DESC, model, agent LIMIT {base}),
                 walk AS (
                   SELECT CAST(0 AS BIGINT) AS i, list_distinct(list(model)) AS ms, list_distinct(list(agent)) AS ags, list(model || '#' || agent ORDER BY usable_trials DESC, model, agent) AS chosen FROM base
                   UNION ALL
                   SELECT p.i, CASE WHEN (len(ms) < 3 OR len(ags) < 3) AND NOT list_contains(ms, p.model) THEN list_append(ms, p.model) ELSE ms END,
                     CASE WHEN (len(ms) < 3 OR len(ags) < 3) AND NOT list_contains(ags, p.agent) THEN list_append(ags, p.agent) ELSE ags END,
                     CASE WHEN (len(ms) < 3 OR len(ags) < 3) AND (NOT list_contains(ms, p.model) OR NOT list_contains(ags, p.agent)) THEN list_append(chosen, p.model || '#' || p.agent) ELSE chosen END
                   FROM walk w JOIN pool p ON p.i = w.i + 1),
                 done AS (SELECT chosen FROM walk ORDER BY i DESC LIMIT 1)
                 SELECT position, split_part(c, '#', 1) AS model, split_part(c, '#', 2) AS agent
                 FROM (SELECT unnest(range(1, len(chosen) + 1)) AS position, unnest(chosen) AS c FROM done) x""")
        for key, base in (("w6_diverse_combos", 6), ("w6_diverse_combos_one", 1))
    ],
    *[
        Query(key, GATE, lambda t, table=table: cov.sample_constraints(pick(t), table(t)),
              gate_sql(f"""SELECT count(*) AS n, count(DISTINCT model || '#' || agent) AS combos, count(DISTINCT model) AS models, count(DISTINCT agent) AS agents, count(DISTINCT reward) AS labels,
                       (SELECT avg(ok::INT) FROM (SELECT {whole} AS ok FROM v_prefixes GROUP BY traj_id) a) AS rule FROM v_pick""",
                       [ge("rows", "n", 100), ge("combos", "combos", 5), ge("models", "models", 3), ge("agents", "agents", 3), ge("labels", "labels", 2), ge("prefix_rule", "rule", 1.0),
                        ge("required_columns", str(columns), 6)],
                       f"CASE WHEN n >= 100 AND combos >= 5 AND models >= 3 AND agents >= 3 AND labels >= 2 AND rule >= 1 AND {columns} >= 6 THEN 'PASS' ELSE 'FAIL' END"))
        for key, table, whole, columns in (
            ("k10_sample_constraints", prefixes, "count(*) = max(n_steps_total) + 1", 6),
            ("k10_damaged_sample", damaged_prefixes, "NOT (substr(md5(traj_id), 1, 1) IN ('0', '1') AND max(n_steps_total) > 0)", 5),
        )
    ],
]
