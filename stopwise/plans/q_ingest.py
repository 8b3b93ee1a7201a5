"""Ingestion, quarantine, prefixes, and file round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopwise import fixed
from stopwise.operators import coverage as cov
from stopwise.operators import ingest
from stopwise.plans import oracle as o
from stopwise.plans.oracle import view
from stopwise.plans.q_coverage import classified
from stopwise.plans.q_policy import decisions
from stopwise.plans.registry import Query, once
from stopwise.session import shared_dir
from stopwise.sources import files, tables


@once()
def checked(t):
    return ingest.quarantine(t.documents_json())


@once()
def contract(t):
    return ingest.to_contract(ingest.passed(checked(t)))


@once()
def trial_runs(t):
    return ingest.remap_trials(classified(t), cov.STEP_SCHEMA)


# ---- SQL: documents described by their fields, not by their text ---------------------------------
view("v_docs_raw", """
SELECT o_orderkey AS k, o_orderpriority AS model_dir, o_orderpriority || '/inst-' || o_orderkey || '.traj.json' AS file, o_orderkey % 24 AS kind,
  o_orderkey % 5 + 1 AS turns, o_orderstatus = 'F' AS resolved FROM orders""")
view("v_docs", """
SELECT *, CASE kind WHEN 7 THEN 'read_json' WHEN 8 THEN 'step_builder' WHEN 0 THEN 'field_validation' WHEN 1 THEN 'field_validation' WHEN 2 THEN 'field_validation'
    WHEN 3 THEN 'field_validation' WHEN 4 THEN 'field_validation' WHEN 5 THEN 'field_validation' WHEN 6 THEN 'field_validation' END AS stage,
  CASE kind WHEN 0 THEN 'NOT_A_JSON_OBJECT' WHEN 1 THEN 'MISSING_INSTANCE_ID' WHEN 2 THEN 'MISSING_OR_EMPTY_MESSAGES' WHEN 3 THEN 'MISSING_INFO' WHEN 4 THEN 'MISSING_RESOLVED_BOOL'
    WHEN 5 THEN 'MISSING_RESOLVED_BOOL' WHEN 6 THEN 'MISSING_MODEL_LABEL' WHEN 7 THEN 'INVALID_JSON' WHEN 8 THEN 'NO_ACTION_MESSAGES_ZERO_STEPS' END AS reason,
  CASE WHEN kind <= 8 THEN 'FAIL' ELSE 'PASS' END AS status FROM v_docs_raw""")
view("v_turns", f"""
SELECT d.*, i, CASE WHEN i % 3 = 1 THEN 'bash' WHEN i % 3 = 0 THEN 'edit' ELSE 'unknown' END AS fn,
  CASE WHEN i % 3 = 1 THEN {o.pick(tables.ACTIONS, '(k + i) % 7')} WHEN i % 3 = 0 THEN '{{"path":"f' || i || '.py"}}' ELSE 'raw ' || i END AS command,
  CASE WHEN i % 3 = 1 THEN '{{"command":"' || {o.pick(tables.ACTIONS, '(k + i) % 7')} || '"}}' WHEN i % 3 = 0 THEN '{{"path":"f' || i || '.py"}}' ELSE 'raw ' || i END AS arguments,
  CASE WHEN i % 2 = 0 THEN i || ' passed, OK' ELSE '1 failed FAILURES' END AS obs
FROM (SELECT *, unnest(range(1, CAST(turns AS BIGINT) + 1)) AS i FROM v_docs) d""")
view("v_messages", """
SELECT model_dir || '::inst-' || k AS traj_id, CAST(0 AS BIGINT) AS pos, 'system' AS role, 'task' AS message_type, NULL AS action, NULL AS fn, NULL AS arguments FROM v_docs WHERE status = 'PASS'
UNION ALL SELECT model_dir || '::inst-' || k, 1, 'user', 'task', NULL, NULL, NULL FROM v_docs WHERE status = 'PASS'
UNION ALL SELECT model_dir || '::inst-' || k, 2 * i, 'assistant', 'action', command, fn, arguments FROM v_turns WHERE status = 'PASS'
UNION ALL SELECT model_dir || '::inst-' || k, 2 * i + 1, 'tool', 'observation', NULL, NULL, NULL FROM v_turns WHERE status = 'PASS'""")
view("v_trial_runs", """
SELECT coalesce(nullif(trial_id, ''), nullif(trial_name, ''), substr(sha256(concat_ws('|', task_name, model, agent, CAST(row_key AS VARCHAR))), 1, 16)) AS traj_id,
  task_name AS instance_id, model AS model_id, agent, reward = 1 AS resolved, row_key FROM v_tri WHERE usable""")
view("v_agent_steps", """
SELECT r.traj_id, r.instance_id, r.model_id, r.resolved, s.row_key, row_number() OVER (PARTITION BY s.row_key ORDER BY pos) AS step_idx,
  array_to_string(json_extract_string(step, '$.tools[*].cmd'), chr(10)) AS action_text, coalesce(step ->> 'obs', '') AS feedback_text
FROM v_step_rows s JOIN v_trial_runs r ON r.row_key = s.row_key WHERE step ->> 'src' = 'agent'""")
view("v_prompts", "SELECT row_key, coalesce(step ->> 'msg', '') AS prompt FROM v_step_rows WHERE pos = 0")
view("v_prefixes", """
SELECT r.traj_id || '#' || k.k AS prefix_id, r.traj_id, r.instance_id, r.model_id, r.resolved::INT AS label, k.n AS n_steps_total, k.k AS prefix_step_idx, 1.0 / (k.n + 1) AS sample_weight,
  p.prompt AS task_prompt_text, coalesce(string_agg(s.action_text, chr(10) ORDER BY s.step_idx), '') AS prefix_action_text,
  coalesce(string_agg(s.feedback_text, chr(10) ORDER BY s.step_idx), '') AS prefix_feedback_text,
  coalesce(max(s.action_text) FILTER (s.step_idx = k.k), '') AS last_action_text, coalesce(max(s.feedback_text) FILTER (s.step_idx = k.k), '') AS last_feedback_text
FROM v_trial_runs r JOIN (SELECT row_key, n_steps - 1 AS n, unnest(range(0, CAST(n_steps AS BIGINT))) AS k FROM v_tri WHERE usable) k ON k.row_key = r.row_key
JOIN v_prompts p ON p.row_key = r.row_key LEFT JOIN v_agent_steps s ON s.row_key = r.row_key AND s.step_idx <= k.k GROUP BY ALL""")


# ---- round trips through files -------------------------------------------------------------------

DEC_SCHEMA = ("traj_id bigint, instance_id string, model_id string, resolved int, n_prefix_rows bigint, n_steps_total int, decision string, decision_step int, "
              "decision_score double, saved_steps int, decided boolean")
DEC = "traj_id:i instance_id:s model_id:s resolved:i decision:s decision_step:i decision_score:d saved_steps:i decided:b"


def dec_rows(t):
    return decisions(t).select(*[c.split()[0] for c in DEC_SCHEMA.split(", ")])


def trials_file(t):
    path = files.write_parquet(t.trials(), shared_dir(t.spark, "trials"))
    return cov.classify_usability(files.scan_trials(t.spark, path))


def csv_file(t):
    path = files.write_csv(dec_rows(t), shared_dir(t.spark, "decisions"))
    return files.scan_csv(t.spark, path, DEC_SCHEMA)


def keyed_csv(t):
    """CSV files in one folder per model; the key is read back from the path."""
    path = shared_dir(t.spark, "keyed")
    rows = dec_rows(t).withColumn("tag", F.concat(F.lit("pair-000"), F.substring("model_id", 1, 1)))
    rows.write.option("header", True).partitionBy("tag").csv(path)
    return files.scan_keyed_by_filename(t.spark, path, r"tag=(pair-\d{4})/[^/]+\.csv$", DEC_SCHEMA)


def folds_file(t):
    rows = dec_rows(t).withColumn("fold_tag", F.concat(F.lit("fold-"), F.substring("model_id", 1, 1)))
    path = files.write_parquet(rows, shared_dir(t.spark, "folds"), ["fold_tag"])
    return files.scan_folds(t.spark, path, DEC_SCHEMA + ", fold_tag string")


def jsonl_file(t):
    path = files.write_jsonl(dec_rows(t), shared_dir(t.spark, "jsonl"))
    return files.read_jsonl(t.spark, path, DEC_SCHEMA)


def report_json(t):
    rows = decisions(t).groupBy("model_id").agg(F.avg("decision_score").alias("mean_score"), (F.lit(0.0) * F.lit(float("nan"))).alias("undefined"))
    path = files.write_report_json(rows, shared_dir(t.spark, "report"))
    return files.read_jsonl(t.spark, path, "model_id string, mean_score double, undefined double")


@once()
def document_files(t):
    """Every document as a file of its own; those of one defect are no text at all."""
    broken = F.col("document") == "{bad"
    content = F.when(broken, F.concat(F.encode("document", "UTF-8"), F.unhex(F.lit("FF")))).otherwise(F.encode("document", "UTF-8"))
    return files.write_run_files(t.documents_json().select("file", content.alias("content")), shared_dir(t.spark, "documents"))


def text_rows(t):
    """A file name for every text: its language, a folder, and the id; every fiftieth lies in a wrong folder."""
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    folder = F.when(F.col("doc_id") % 50 == 0, "elsewhere").otherwise(name)
    return t.docs().select("doc_id", F.concat_ws("/", "lang", folder, F.concat(name, F.lit(".traj.json"))).alias("file"), "text")


@once()
def text_files(t):
    return files.write_run_files(text_rows(t).select("file", F.encode("text", "UTF-8").alias("content")), shared_dir(t.spark, "texts"))


def manifest(t):
    return files.dataset_manifest(files.digest_files(t.spark, text_files(t), "*.traj.json"))


view("v_text_files", """SELECT doc_id, lang, text, lang || '/' || CASE WHEN doc_id % 50 = 0 THEN 'elsewhere' ELSE 'doc-' || doc_id END || '/doc-' || doc_id || '.traj.json' AS file
FROM documents""")

REASON = "status:s stage:s reason:s"
PREFIX = ("prefix_id:s traj_id:s instance_id:s model_id:s label:i n_steps_total:i prefix_step_idx:i sample_weight:d task_prompt_text:s prefix_action_text:s prefix_feedback_text:s "
          "last_action_text:s last_feedback_text:s")
_NAMES = ("CASE WHEN turns >= 3 THEN 'bash|edit|unknown' WHEN turns = 2 THEN 'bash|unknown' ELSE 'bash' END")
_ARGS = ("CASE WHEN turns >= 3 THEN 'NON_DICT_ARGUMENTS|command|path' WHEN turns = 2 THEN 'NON_DICT_ARGUMENTS|command' ELSE 'command' END")

QUERIES = [
    Query("a1_scan_traj_json", "file:s model_dir:s status:s stage:s reason:s error:s", lambda t: ingest.quarantine(files.scan_traj_json(t.spark, document_files(t))),
          "SELECT file, model_dir, status, stage, reason, CASE WHEN kind = 7 THEN 'NOT_UTF8' END AS error FROM v_docs"),
    Query("a10_digest_written", "file:s bytes:i sha256:s", lambda t: files.digest_files(t.spark, text_files(t), "*.traj.json"),
          "SELECT file, strlen(text) AS bytes, sha256(text) AS sha256 FROM v_text_files"),
    Query("a2_scan_columns", "l_orderkey:i l_quantity:d",
          lambda t: files.scan_columns(t.spark, f"{t.path}/lineitem.parquet", ["l_orderkey", "not_there", "l_quantity"]),
          "SELECT l_orderkey, l_quantity FROM lineitem"),
    Query("a3_scan_trials", "row_key:i steps_state:s usable:b reason:s", trials_file, "SELECT * FROM v_tri"),
    Query("a4_scan_csv", DEC, csv_file, "SELECT * FROM v_dec"),
    Query("a5_scan_keyed_by_filename", "pair_id:s " + DEC, keyed_csv, "SELECT *, 'pair-000' || substr(model_id, 1, 1) AS pair_id FROM v_dec"),
    Query("a6_scan_folds", "fold_tag:s " + DEC, folds_file, "SELECT *, 'fold-' || substr(model_id, 1, 1) AS fold_tag FROM v_dec"),
    Query("a7_jsonl", DEC, jsonl_file, "SELECT * FROM v_dec"),
    Query("a8_write_parquet", DEC,
          lambda t: t.spark.read.schema(DEC_SCHEMA).parquet(files.write_parquet(dec_rows(t), shared_dir(t.spark, "parquet"), ["model_id"])),
          "SELECT * FROM v_dec"),
    Query("a9_report_json", "model_id:s mean_score:d undefined:d", report_json,
          "SELECT model_id, avg(decision_score) AS mean_score, CAST(NULL AS DOUBLE) AS undefined FROM v_dec GROUP BY 1"),
    Query("a10_digest_files", "file:s bytes:i sha256:s", lambda t: files.digest_files(t.spark, t.path, "*.parquet")),
    Query("a11_dataset_manifest", "model:s files:i bytes:i zero_byte_files:i misplaced_files:i", manifest,
          """SELECT lang AS model, count(*) AS files, sum(strlen(text)) AS bytes, count(*) FILTER (text = '') AS zero_byte_files, count(*) FILTER (doc_id % 50 = 0) AS misplaced_files
             FROM v_text_files GROUP BY 1"""),
    Query("a11_common_instances", "union_instances:i common_instances:i", lambda t: files.common_instances(t.runs()),
          """SELECT count(*) AS union_instances, count(*) FILTER (n = (SELECT count(DISTINCT model_id) FROM v_runs)) AS common_instances
             FROM (SELECT instance_id, count(DISTINCT model_id) AS n FROM v_runs GROUP BY 1) x"""),
    Query("a12_shard_profile", "file:s rows:i columns:i", lambda t: files.shard_profile(t.spark, f"{t.path}/lineitem.parquet"),
          "SELECT 'lineitem.parquet' AS file, count(*) AS rows, 11 AS columns FROM lineitem"),
    Query("b1_validate_fields", "file:s reason:s",
          lambda t: ingest.parse_documents(t.documents_json()).where(F.col("doc").isNotNull()).withColumn("reason", ingest.validate_fields()),
          "SELECT file, CASE WHEN kind <> 8 THEN reason END AS reason FROM v_docs WHERE kind <> 7"),
    Query("b2_normalize_tool_calls", "traj_id:s pos:i name:s arguments:s",
          lambda t: contract(t).select("traj_id", F.posexplode("messages").alias("pos", "m")).select("traj_id", "pos", F.inline("m.tool_calls")),
          "SELECT traj_id, pos, fn AS name, arguments FROM v_messages WHERE role = 'assistant'"),
    Query("b3_command_of", "traj_id:s pos:i action:s",
          lambda t: ingest.message_rows(contract(t)).where(F.col("role") == "assistant"),
          "SELECT traj_id, pos, action FROM v_messages WHERE role = 'assistant'"),
    Query("b4_adapt_messages", "traj_id:s pos:i role:s message_type:s action:s", lambda t: ingest.message_rows(contract(t)), "SELECT * FROM v_messages"),
    Query("b4_adapt_conversations", "conv_id:i turn:i role:s message_type:s",
          lambda t: t.messages().withColumn("message_type", ingest.message_type(F.col("role"))),
          """SELECT conv_id, turn, role, CASE role WHEN 'assistant' THEN 'action' WHEN 'tool' THEN 'observation' WHEN 'system' THEN 'task' WHEN 'user' THEN 'task' ELSE role END AS message_type
             FROM conversations"""),
    Query("b5_to_contract", "traj_id:s instance_id:s model_id:s resolved:b patch:s n_messages:i",
          lambda t: contract(t).withColumn("n_messages", F.size("messages")),
          "SELECT model_dir || '::inst-' || k AS traj_id, 'inst-' || k AS instance_id, model_dir AS model_id, resolved, 'patch' AS patch, 2 + 2 * turns AS n_messages FROM v_docs WHERE status = 'PASS'"),
    Query("b6_remap_trial_row", "traj_id:s instance_id:s model_id:s agent:s resolved:b n_messages:i n_actions:i actions:s",
          lambda t: trial_runs(t).select(
              "*", F.size("messages").alias("n_messages"), F.size(F.filter("messages", lambda m: m["role"] == "assistant")).alias("n_actions"),
              F.array_join(F.transform(F.filter("messages", lambda m: m["role"] == "assistant"), lambda m: m["action"]), ";").alias("actions")),
          """SELECT r.traj_id, r.instance_id, r.model_id, r.agent, r.resolved, m.n_messages, coalesce(a.n, 0) AS n_actions, coalesce(a.actions, '') AS actions
             FROM v_trial_runs r JOIN (SELECT row_key, count(*) + count(*) FILTER (coalesce(step ->> 'obs', '') <> '') AS n_messages FROM v_step_rows GROUP BY 1) m ON m.row_key = r.row_key
             LEFT JOIN (SELECT row_key, count(*) AS n, string_agg(action_text, ';' ORDER BY step_idx) AS actions FROM v_agent_steps GROUP BY 1) a ON a.row_key = r.row_key"""),
    Query("b7_quarantine", "file:s " + REASON, checked, "SELECT * FROM v_docs"),
    Query("b7_reconcile_counts", "raw:i pass:i fail:i reconciled:b", lambda t: ingest.reconcile_counts(checked(t)),
          "SELECT count(*) AS raw, count(*) FILTER (status = 'PASS') AS pass, count(*) FILTER (status = 'FAIL') AS fail, true AS reconciled FROM v_docs"),
    Query("b9_expand_prefixes", PREFIX, lambda t: ingest.expand_prefixes(trial_runs(t)), "SELECT * FROM v_prefixes"),
    Query("b9_step_texts", "traj_id:s model_id:s step_idx:i action_text:s feedback_text:s", lambda t: ingest.step_texts(trial_runs(t)), "SELECT * FROM v_agent_steps"),
    Query("b12_source_schema_audit",
          "file:s messages:i message_keys:s roles:s action_messages:i test_commands:i edit_commands:i submit_markers:i pass_hits:i fail_hits:i function_names:s argument_keys:s",
          lambda t: ingest.source_schema_audit(ingest.passed(checked(t))),
          f"""SELECT file, 2 + 2 * turns AS messages, 'content|role|tool_calls' AS message_keys, 'assistant|system|tool|user' AS roles, turns AS action_messages,
               count(*) FILTER (regexp_matches(command, '(?i)(pytest|python\\s+-m\\s+unittest)')) AS test_commands,
               count(*) FILTER (regexp_matches(command, '(?i)(sed\\s+-i|git\\s+apply|cat\\s*>)')) AS edit_commands,
               count(*) FILTER (contains(command, 'COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT')) AS submit_markers,
               2 * count(*) FILTER (i % 2 = 0) AS pass_hits, 2 * count(*) FILTER (i % 2 = 1) AS fail_hits, {_NAMES} AS function_names, {_ARGS} AS argument_keys
             FROM v_turns WHERE status = 'PASS' GROUP BY file, turns"""),
    Query("b13_reference_prune", "traj_id:i n_columns:i",
          lambda t: (lambda d: d.select("traj_id", F.lit(len(d.columns)).alias("n_columns")))(
              ingest.drop_reference_columns(t.runs().withColumns({"gold_patch": F.lit("x"), "gold_files": F.lit(1)}))),
          "SELECT traj_id, 4 AS n_columns FROM v_runs"),
    *[
        Query(key, "prefix_id:s target_success:i target_failure:i", lambda t, step=step: ingest.safe_targets(ingest.expand_prefixes(trial_runs(t)), step),
              f"SELECT prefix_id, (label = 1 AND prefix_step_idx >= {step})::INT AS target_success, (label = 0 AND prefix_step_idx >= {step})::INT AS target_failure FROM v_prefixes")
        for key, step in (("b14_safe_targets", fixed.SAFE_TARGET_MIN_STEP), ("b14_safe_targets_early", 3))
    ],
    Query("b22_dedup_trajectories", "traj_id:i prefix_step_idx:i p_success:d p_failure:d",
          lambda t: ingest.dedup_first(t.preds(), "traj_id", ["prefix_step_idx"]),
          "SELECT traj_id, prefix_step_idx, p_success, p_failure FROM v_preds QUALIFY row_number() OVER (PARTITION BY traj_id ORDER BY prefix_step_idx) = 1"),
    Query("e32_adapter_failure_summary", "model_dir:s stage:s reason:s label:s failures:i", lambda t: ingest.failure_summary(checked(t)),
          """SELECT model_dir, stage, reason, CASE WHEN kind IN (0, 3, 7) THEN 'UNKNOWN' WHEN kind IN (4, 5) THEN 'true' ELSE CAST(resolved AS VARCHAR) END AS label, count(*) AS failures
             FROM v_docs WHERE status = 'FAIL' GROUP BY 1, 2, 3, 4"""),
    Query("e44_ingest_report",
          "model_id:s raw:i passed:i failed:i runs:i unique_ids:i duplicated_ids:i length_min:i length_median:d length_max:i prefix_rows:i",
          lambda t: ingest.ingest_report(classified(t), trial_runs(t), ingest.expand_prefixes(trial_runs(t))),
          """SELECT model AS model_id, count(*) AS raw, count(*) FILTER (usable) AS passed, count(*) FILTER (NOT usable) AS failed, count(*) FILTER (usable) AS runs,
               (SELECT count(DISTINCT traj_id) FROM v_trial_runs r WHERE r.model_id = model) AS unique_ids, 0 AS duplicated_ids,
               min(n_steps - 1) FILTER (usable) AS length_min, median(n_steps - 1) FILTER (usable) AS length_median, max(n_steps - 1) FILTER (usable) AS length_max,
               sum(n_steps) FILTER (usable) AS prefix_rows FROM v_tri GROUP BY 1"""),
    Query("w7_stride_sample", "model_id:s instance_id:s pick:i",
          lambda t: ingest.stride_sample(t.runs().select("model_id", "instance_id").distinct(), 10),
          """SELECT model_id, instance_id, rn // s AS pick FROM (
               SELECT model_id, instance_id, row_number() OVER (PARTITION BY model_id ORDER BY instance_id) - 1 AS rn, greatest(1, count(*) OVER (PARTITION BY model_id) // 10) AS s
               FROM (SELECT DISTINCT model_id, instance_id FROM v_runs) a) b WHERE rn % s = 0 AND rn // s < 10"""),
]
