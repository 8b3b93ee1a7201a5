"""From raw run documents and wide trial rows to normalised runs, steps and prefixes.

A run is one document, so its messages and prefixes are handled inside the row: no shuffle, and no
state outside the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise import fixed
from stopwise.operators.ranking import range_ids

MESSAGES = (
    "array<struct<role:string,content:string,tool_calls:array<struct<id:string,function:variant,arguments:variant>>>>"
)
NO_CALLS = "array<struct<id:string,function:variant,arguments:variant>>"


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def evaluate_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a generator of one row.

    The optimizer copies a projected expression into every later filter and branch that uses it;
    a generated column is computed once per row. Worth it for parsing, not for arithmetic.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def parse_documents(docs: DataFrame) -> DataFrame:
    return evaluate_once(docs, doc=F.try_parse_json("document"))


def validate_fields(doc: str = "doc") -> Column:
    """First failing rule in fixed order, NULL when every rule holds. Types are strict.

    The type of a whole document or list is a walk through all of it, so it is looked up only where a
    field inside it is missing: what has an instance id is an object, and what has a first element is a list.
    """
    v = F.col(doc)
    empty = lambda path: F.coalesce(_get(v, path, "string"), F.lit("")) == ""
    no_object = lambda c: ~_kind(c).startswith("OBJECT")
    return (
        F.when(empty("$.instance_id"), F.when(no_object(v), "NOT_A_JSON_OBJECT").otherwise("MISSING_INSTANCE_ID"))
        .when(_get(v, "$.messages[0]").isNull(), "MISSING_OR_EMPTY_MESSAGES")
        .when(
            _kind(_get(v, "$.info.resolved")) != "BOOLEAN",
            F.when(no_object(_get(v, "$.info")), "MISSING_INFO").otherwise("MISSING_RESOLVED_BOOL"),
        )
        .when(empty("$.info.docent.model_label"), "MISSING_MODEL_LABEL")
    )


def resolve_calls(calls: Column) -> Column:
    """Tool calls of either shape as (id, name, keyed, arguments).

    Done in two passes over the array so that each variant's type is looked up once: the first one
    finds the shape, the second the arguments.
    """
    shaped = F.transform(calls, lambda c: F.struct(c["id"].alias("id"), c["function"].alias("fn"), c["arguments"].alias("args"), _kind(c["function"]).alias("kind")))
    named = F.transform(
        shaped,
        lambda c: F.struct(
            c["id"].alias("id"),
            F.when(c["kind"] == "STRING", c["fn"].cast("string"))
            .when(c["kind"].startswith("OBJECT"), F.coalesce(_get(c["fn"], "$.name", "string"), F.lit("unknown")))
            .otherwise("unknown")
            .alias("name"),
            F.when(c["kind"].startswith("OBJECT"), _get(c["fn"], "$.arguments")).otherwise(c["args"]).alias("args"),
        ),
    )
    return F.transform(
        named, lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name"), c["args"].alias("args"), _kind(c["args"]).alias("kind"))
    )


def with_text(calls: Column) -> Column:
    """Arguments as text (strings as they are, everything else as compact JSON) and the command."""
    texts = F.transform(
        calls,
        lambda c: F.struct(
            c["id"].alias("id"),
            c["name"].alias("name"),
            F.coalesce(F.when(c["kind"] == "STRING", c["args"].cast("string")).otherwise(F.to_json(c["args"])), F.lit("")).alias("arguments"),
            F.when(c["kind"].startswith("OBJECT"), _get(c["args"], "$.command", "string")).alias("command"),
        ),
    )
    return F.transform(
        texts,
        lambda c: F.struct(
            c["id"].alias("id"),
            F.lit("function").alias("type"),
            c["name"].alias("name"),
            c["arguments"].alias("arguments"),
            F.coalesce(c["command"], c["arguments"]).alias("command"),
        ),
    )


def adapt_messages(messages: Column) -> Column:
    """Messages with their kind, command text and tool calls in one shape."""
    resolved = F.transform(
        messages,
        lambda m: F.struct(
            m["role"].alias("role"),
            m["content"].alias("content"),
            with_text(resolve_calls(m["tool_calls"])).alias("tool_calls"),
        ),
    )
    return F.transform(
        resolved,
        lambda m: F.struct(
            m["role"].alias("role"),
            m["content"].alias("content"),
            message_type(m["role"]).alias("message_type"),
            F.when(
                m["role"] == "assistant",
                F.coalesce(F.array_join(F.transform(m["tool_calls"], lambda c: c["command"]), "\n"), F.lit("")),
            ).alias("action"),
            m["tool_calls"].alias("tool_calls"),
        ),
    )


def message_type(role: Column) -> Column:
    return (
        F.when(role == "assistant", "action")
        .when(role == "tool", "observation")
        .when(role.isin("system", "user"), "task")
        .otherwise(role)
    )


def resolved(doc: str = "doc") -> Column:
    """The outcome of a run; without one it is not resolved."""
    return F.coalesce(_get(F.col(doc), "$.info.resolved", "boolean"), F.lit(False))


def to_contract(parsed: DataFrame) -> DataFrame:
    """Normalised run rows of documents that passed ``quarantine``."""
    v = F.col("doc")
    model, instance = _get(v, "$.info.docent.model_label", "string"), _get(v, "$.instance_id", "string")
    return parsed.select(
        F.lit("repository-tasks").alias("benchmark"),
        instance.alias("instance_id"),
        F.concat_ws("::", model, instance).alias("traj_id"),
        model.alias("model_id"),
        resolved().alias("resolved"),
        adapt_messages(F.col("messages")).alias("messages"),
        F.coalesce(_get(v, "$.info.submission", "string"), F.lit("")).alias("patch"),
    )


def quarantine(docs: DataFrame) -> DataFrame:
    """Every document with its stage and reason; PASS rows have neither."""
    typed = evaluate_once(parse_documents(docs), messages=_get(F.col("doc"), "$.messages", MESSAGES))
    acting = F.filter("messages", lambda m: (m["role"] == "assistant") & m["tool_calls"].isNotNull())
    parsed = evaluate_once(typed, found=validate_fields(), n_actions=F.size(acting))
    reason, actions = F.col("found"), F.col("n_actions")
    stage = (
        F.when(F.col("doc").isNull(), "read_json")
        .when(F.col("reason").isNotNull(), "field_validation")
        .when(actions <= 0, "step_builder")
    )
    return (
        parsed.withColumn("reason", F.when(F.col("doc").isNotNull(), reason))
        .withColumn("stage", stage)
        .withColumn(
            "reason",
            F.when(F.col("stage") == "read_json", "INVALID_JSON")
            .when(F.col("stage") == "step_builder", "NO_ACTION_MESSAGES_ZERO_STEPS")
            .otherwise(F.col("reason")),
        )
        .withColumn("status", F.when(F.col("stage").isNull(), "PASS").otherwise("FAIL"))
    )


def passed(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("status") == "PASS")


def failed(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("status") == "FAIL").select("model_dir", "file", "stage", "reason", "doc")


def failure_summary(checked: DataFrame) -> DataFrame:
    """Failures by model folder, stage and reason, with labels recovered from the document."""
    label = F.coalesce(_get(F.col("doc"), "$.info.resolved", "boolean").cast("string"), F.lit("UNKNOWN"))
    return failed(checked).withColumn("label", label).groupBy("model_dir", "stage", "reason", "label").agg(
        F.count(F.lit(1)).alias("failures")
    )


def reconcile_counts(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count(F.lit(1)).alias("raw"),
        F.count_if(F.col("status") == "PASS").alias("pass"),
        F.count_if(F.col("status") == "FAIL").alias("fail"),
        (F.count(F.lit(1)) == F.count_if(F.col("status") == "PASS") + F.count_if(F.col("status") == "FAIL")).alias("reconciled"),
    )


def message_rows(runs: DataFrame) -> DataFrame:
    return runs.select("traj_id", F.posexplode("messages").alias("pos", "m")).select(
        "traj_id", "pos", "m.role", "m.message_type", "m.action", F.to_json("m.tool_calls").alias("tool_calls")
    )


def source_schema_audit(parsed: DataFrame) -> DataFrame:
    """Roles, keys, command and observation counts of every document, all inside the row."""
    v = F.col("doc")
    none = F.array().cast(NO_CALLS)
    shaped = parsed.select(
        "file",
        F.col("messages").alias("msgs"),
        _get(v, "$.messages", "array<map<string,variant>>").alias("maps"),
    )
    acting = F.filter("msgs", lambda m: (m["role"] == "assistant") & (F.size(F.coalesce(m["tool_calls"], none)) > 0))
    texts = F.transform(F.filter("msgs", lambda m: m["role"] == "tool"), lambda m: F.coalesce(m["content"], F.lit("")))
    called = shaped.select(
        "file",
        "msgs",
        "maps",
        F.transform(acting, lambda m: with_text(resolve_calls(m["tool_calls"]))).alias("acting"),
        resolve_calls(F.flatten(F.transform("msgs", lambda m: F.coalesce(m["tool_calls"], none)))).alias("calls"),
        F.array_join(texts, "\n").alias("observations"),
    )
    commands = F.transform("acting", lambda cs: F.array_join(F.transform(cs, lambda c: c["command"]), "\n"))
    ready = called.withColumn("commands", commands)
    listed = lambda arr: F.array_join(F.array_sort(F.array_distinct(arr)), "|")
    hits = lambda text, pattern: F.regexp_count(text, F.lit(pattern))
    arg_keys = F.transform(
        "calls",
        lambda c: F.when(
            c["kind"].startswith("OBJECT"), F.array_join(F.array_sort(F.map_keys(c["args"].cast("map<string,variant>"))), "|")
        ).otherwise("NON_DICT_ARGUMENTS"),
    )
    return ready.select(
        "file",
        F.size("msgs").alias("messages"),
        listed(F.flatten(F.transform("maps", lambda m: F.map_keys(m)))).alias("message_keys"),
        listed(F.transform("msgs", lambda m: m["role"])).alias("roles"),
        F.size("acting").alias("action_messages"),
        F.size(F.filter("commands", lambda c: c.rlike(fixed.AUDIT_TEST_PATTERN))).alias("test_commands"),
        F.size(F.filter("commands", lambda c: c.rlike(fixed.AUDIT_EDIT_PATTERN))).alias("edit_commands"),
        (hits(F.array_join("commands", "\n"), fixed.SUBMIT_MARKER) + hits(F.col("observations"), fixed.SUBMIT_MARKER)).alias("submit_markers"),
        hits(F.col("observations"), fixed.AUDIT_PASS_PATTERN).alias("pass_hits"),
        hits(F.col("observations"), fixed.AUDIT_FAIL_PATTERN).alias("fail_hits"),
        listed(F.transform("calls", lambda c: c["name"])).alias("function_names"),
        listed(arg_keys).alias("argument_keys"),
    )


def remap_trials(classified: DataFrame, step_schema: str) -> DataFrame:
    """Usable trial rows as normalised runs with their messages.

    The fallback of an empty id is a hash of the row's content: stable under any partitioning, which
    a row number would not be.
    """
    steps = F.from_json("steps", step_schema)
    row_hash = F.substring(F.sha2(F.concat_ws("|", "task_name", "model", "agent", F.col("row_key").cast("string")), 256), 1, 16)
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    message = lambda s: F.array_compact(
        F.array(
            F.struct(
                F.when(s["src"] == "agent", "assistant").otherwise(s["src"]).alias("role"),
                s["msg"].alias("content"),
                F.when(s["src"] == "agent", F.array_join(F.transform(s["tools"], lambda x: x["cmd"]), "\n")).alias("action"),
            ),
            F.when(
                F.coalesce(s["obs"], F.lit("")) != "",
                F.struct(F.lit("tool").alias("role"), s["obs"].alias("content"), F.lit(None).cast("string").alias("action")),
            ),
        )
    )
    return classified.where("usable").select(
        F.coalesce(blank("trial_id"), blank("trial_name"), row_hash).alias("traj_id"),
        F.col("task_name").alias("instance_id"),
        F.col("model").alias("model_id"),
        "agent",
        (F.col("reward") == 1).alias("resolved"),
        F.flatten(F.transform(steps, message)).alias("messages"),
        steps.alias("steps"),
    )


def expand_prefixes(runs: DataFrame) -> DataFrame:
    """n executed steps give n + 1 prefixes, with cumulative and last texts.

    Everything is cut from the run's own arrays. The cumulative text is quadratic in run length by
    definition; term counts use ``step_texts`` instead and never build it.
    """
    acting = F.filter("steps", lambda s: s["src"] == "agent")
    actions = F.transform(acting, lambda s: F.coalesce(F.array_join(F.transform(s["tools"], lambda x: x["cmd"]), "\n"), F.lit("")))
    feedback = F.transform(acting, lambda s: F.coalesce(s["obs"], F.lit("")))
    prompt = F.coalesce(F.get(F.filter("steps", lambda s: s["src"] != "agent"), F.lit(0))["msg"], F.lit(""))
    base = runs.select(
        "traj_id",
        "instance_id",
        "model_id",
        F.col("resolved").cast("int").alias("label"),
        actions.alias("actions"),
        feedback.alias("feedback"),
        prompt.alias("task_prompt_text"),
        F.size(actions).alias("n_steps_total"),
    )
    k = F.col("prefix_step_idx")
    until = lambda c: F.array_join(F.slice(c, F.lit(1), k), "\n")
    last = lambda c: F.when(k > 0, F.get(c, k - 1)).otherwise("")
    return base.withColumn("prefix_step_idx", F.explode(F.sequence(F.lit(0), "n_steps_total"))).select(
        F.concat_ws("#", "traj_id", k.cast("string")).alias("prefix_id"),
        "traj_id",
        "instance_id",
        "model_id",
        "label",
        "n_steps_total",
        "prefix_step_idx",
        F.try_divide(F.lit(1.0), F.col("n_steps_total") + 1).alias("sample_weight"),
        "task_prompt_text",
        until("actions").alias("prefix_action_text"),
        until("feedback").alias("prefix_feedback_text"),
        last("actions").alias("last_action_text"),
        last("feedback").alias("last_feedback_text"),
    )


def step_texts(runs: DataFrame) -> DataFrame:
    """One row per executed step with its own text only."""
    acting = F.filter("steps", lambda s: s["src"] == "agent")
    return runs.select("traj_id", "model_id", F.posexplode(acting).alias("pos", "s")).select(
        "traj_id",
        "model_id",
        (F.col("pos") + 1).alias("step_idx"),
        F.coalesce(F.array_join(F.transform(F.col("s.tools"), lambda x: x["cmd"]), "\n"), F.lit("")).alias("action_text"),
        F.coalesce("s.obs", F.lit("")).alias("feedback_text"),
    )


def dedup_first(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First whole row per key in an explicit order, as one aggregate (no sort of a hot key's rows).

    Ties in the order are broken by the other columns, so values of different rows never mix.
    """
    rest = [c for c in rows.columns if c != key and c not in order]
    first = rows.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("row"))
    return first.select(key, "row.*").select(*rows.columns)


def ingest_report(checked: DataFrame, runs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Pass and fail counts, unique and duplicate run ids, and run lengths, per model."""
    ids = runs.groupBy("model_id", "traj_id").agg(F.count(F.lit(1)).alias("n"))
    unique = ids.groupBy("model_id").agg(
        F.sum("n").alias("runs"), F.count(F.lit(1)).alias("unique_ids"), F.count_if(F.col("n") > 1).alias("duplicated_ids")
    )
    lengths = prefixes.where(F.col("prefix_step_idx") == 0).groupBy("model_id").agg(
        F.min("n_steps_total").alias("length_min"),
        F.median("n_steps_total").alias("length_median"),
        F.max("n_steps_total").alias("length_max"),
        F.sum(F.col("n_steps_total") + 1).alias("prefix_rows"),
    )
    counts = checked.groupBy(F.col("model").alias("model_id")).agg(
        F.count(F.lit(1)).alias("raw"), F.count_if("usable").alias("passed"), F.count_if(~F.col("usable")).alias("failed")
    )
    return counts.join(unique, "model_id", "left").join(lengths, "model_id", "left")


def drop_reference_columns(df: DataFrame, prefix: str = "gold_") -> DataFrame:
    """Leave out label-bearing columns by name; they are pruned at the scan."""
    return df.select([c for c in df.columns if not c.startswith(prefix)])


def safe_targets(rows: DataFrame, min_step: int = fixed.SAFE_TARGET_MIN_STEP) -> DataFrame:
    late = F.col("prefix_step_idx") >= min_step
    return rows.withColumns(
        {
            "target_success": ((F.col("label") == 1) & late).cast("int"),
            "target_failure": ((F.col("label") == 0) & late).cast("int"),
        }
    )


def stride_sample(files: DataFrame, per_model: int) -> DataFrame:
    """Every floor(n / k)-th name of each model, the first k of them.

    Positions come from sampled name ranges with measured offsets, so a model with very many files is
    many tasks.
    """
    numbered = range_ids(files, ["model_id"], ["instance_id"], "rn").withColumnRenamed("rn_total", "n")
    step = F.greatest(F.lit(1), F.floor(F.col("n") / per_model))
    return numbered.where((F.col("rn") % step == 0) & (F.floor(F.col("rn") / step) < per_model)).select(
        "model_id", "instance_id", F.floor(F.col("rn") / step).alias("pick")
    )
