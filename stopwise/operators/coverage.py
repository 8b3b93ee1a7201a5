"""Usability of wide trial rows, coverage of combinations, missingness and design connectivity.

JSON is parsed row by row inside the scan stage. Everything after that works on counts per
(model, scaffold, task), so a scaffold or model that owns a third of the rows is combined on the
map side before the first shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from stopwise import fixed
from stopwise.functions import stats
from stopwise.operators.ingest import evaluate_once
from stopwise.session import materialize

STEP_SCHEMA = "array<struct<src:string,msg:string,tools:array<struct<fn:string,cmd:string>>,obs:string>>"
STATES = ("NULL_FIELD", "EMPTY_STRING", "PARSE_FAIL", "JSON_NULL", "NOT_LIST", "EMPTY_LIST", "OK")
REASONS = ("TRAJECTORY_USABLE", "MISSING_REWARD", "NON_BINARY_REWARD", "SCHEMA_FAIL", "NO_STEPS", "OTHER")


def steps_state(col: str = "steps") -> Column:
    """State of a JSON steps field, from the parsed value's own type."""
    kind = F.schema_of_variant(F.try_parse_json(col))
    return (
        F.when(F.col(col).isNull(), "NULL_FIELD")
        .when(F.col(col) == "", "EMPTY_STRING")
        .when(kind.isNull(), "PARSE_FAIL")
        .when(kind == "VOID", "JSON_NULL")
        .when(~kind.startswith("ARRAY"), "NOT_LIST")
        .when(F.json_array_length(col) == 0, "EMPTY_LIST")
        .otherwise("OK")
    )


def classify_usability(trials: DataFrame) -> DataFrame:
    """State, independent flags and one exclusive reason per row."""
    state = F.col("steps_state")
    binary = F.coalesce(F.col("reward").isin(0, 1), F.lit(False))
    has = state == "OK"
    read = evaluate_once(trials, steps_state=steps_state(), listed=F.json_array_length("steps"))
    return read.withColumns(
        {
            "has_steps": has,
            "binary_reward": binary,
            "schema_fail": state.isin("PARSE_FAIL", "NOT_LIST"),
            "usable": binary & has,
            "n_steps": F.when(has, F.col("listed")),
            "reason": F.when(binary & has, "TRAJECTORY_USABLE")
            .when(F.col("reward").isNull(), "MISSING_REWARD")
            .when(~binary, "NON_BINARY_REWARD")
            .when(state.isin("PARSE_FAIL", "NOT_LIST"), "SCHEMA_FAIL")
            .when(~has, "NO_STEPS")
            .otherwise("OTHER"),
        }
    ).drop("listed")


def task_counts(classified: DataFrame) -> DataFrame:
    """Counts per (model, scaffold, task): the base of every coverage table."""
    u = F.col("usable")
    return classified.groupBy("model", "agent", "task_name").agg(
        F.count(F.lit(1)).alias("all_trials"),
        F.count_if(u).alias("usable"),
        F.count_if(u & (F.col("reward") == 1)).alias("successes"),
        F.count_if(u & (F.col("reward") == 0)).alias("failures"),
        F.count_if(F.col("reward") == 1).alias("successes_all"),
        F.count_if(F.col("reward") == 0).alias("failures_all"),
        F.coalesce(F.sum(F.when(u, F.col("n_steps"))), F.lit(0)).alias("steps"),
    )


def combo_coverage(counts: DataFrame) -> DataFrame:
    """Coverage and eligibility of each (model, scaffold) combination."""
    cell = F.when(F.col("usable") > 0, F.col("usable"))
    combos = counts.groupBy("model", "agent").agg(
        F.sum("all_trials").alias("all_trials"),
        F.sum("usable").alias("usable_trials"),
        F.count(cell).alias("unique_tasks"),
        F.sum("successes").alias("successes"),
        F.sum("failures").alias("failures"),
        F.avg(cell).alias("trials_per_task_mean"),
        F.median(cell).alias("trials_per_task_median"),
        F.min(cell).alias("trials_per_task_min"),
        F.max(cell).alias("trials_per_task_max"),
        stats.ratio(F.sum("steps"), F.sum("usable")).alias("mean_steps"),
    )
    fraction = stats.ratio("usable_trials", "all_trials")
    return combos.withColumns(
        {
            "usable_fraction": fraction,
            "success_rate": stats.ratio("successes", "usable_trials"),
            "low_coverage": F.coalesce(fraction < fixed.LOW_COVERAGE, F.lit(False)),
            "ineligible_reasons": failed_rules(
                [
                    ("USABLE_LT_100", F.col("usable_trials") < fixed.COMBO_MIN_USABLE),
                    ("SUCCESS_LT_20", F.col("successes") < fixed.COMBO_MIN_SUCCESSES),
                    ("FAILURE_LT_20", F.col("failures") < fixed.COMBO_MIN_FAILURES),
                    ("TASKS_LT_30", F.col("unique_tasks") < fixed.COMBO_MIN_TASKS),
                ]
            ),
        }
    ).withColumn("eligible", F.col("ineligible_reasons") == "")


def failed_rules(rules: Sequence[tuple[str, Column]]) -> Column:
    """Names of the failed rules, joined by pipes in rule order."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules])), "|")


def corpus_profile(classified: DataFrame) -> DataFrame:
    """Totals, states, reasons and flags of the corpus in one pass over the rows."""
    u = F.col("usable")
    return classified.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("has_steps").alias("rows_with_steps"),
        F.count_if(u).alias("usable_rows"),
        *[F.count_if(F.col("steps_state") == s).alias(f"state_{s.lower()}") for s in STATES],
        *[F.count_if(F.col("reason") == r).alias(f"reason_{r.lower()}") for r in REASONS],
        F.count_if(F.col("reward").isNull()).alias("reward_missing"),
        F.count_if(F.col("reward").isNotNull() & ~F.col("binary_reward")).alias("reward_non_binary"),
        F.count_if(u & (F.col("trial_id") != "")).alias("usable_with_trial_id"),
        F.coalesce(F.sum(F.when(u, F.col("n_steps"))), F.lit(0)).alias("usable_steps"),
    )


def corpus_distinct(classified: DataFrame) -> DataFrame:
    """Distinct tasks, models, scaffolds, combinations and trial ids, over all and usable rows.

    Each dimension is deduplicated on its own keys first; no row set is gathered in one place.
    """
    u = F.col("usable")
    dims = {
        "tasks": F.col("task_name"),
        "models": F.col("model"),
        "agents": F.col("agent"),
        "combos": F.concat_ws("\u0001", "model", "agent"),
        "trial_ids": F.when(F.col("trial_id") != "", F.col("trial_id")),
    }
    items = F.array(*[F.struct(F.lit(n).alias("dimension"), v.alias("value")) for n, v in dims.items()])
    values = classified.select("usable", F.inline(items)).where(F.col("value").isNotNull())
    per_value = values.groupBy("dimension", "value").agg(F.bool_or("usable").alias("used"))
    return per_value.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if("used").alias("n_usable")
    )


def parsed_steps(classified: DataFrame) -> DataFrame:
    """One row per step of usable trials, with its keys and typed fields."""
    return (
        classified.where("usable")
        .select("model", "agent", "row_key", "steps", F.from_json("steps", STEP_SCHEMA).alias("typed"), F.from_json("steps", "array<map<string,string>>").alias("maps"))
        .select("model", "agent", "row_key", F.posexplode(F.arrays_zip("typed", "maps")).alias("pos", "item"))
        .select("model", "agent", "row_key", "pos", F.col("item.typed").alias("step"), F.map_keys("item.maps").alias("keys"))
    )


def step_histograms(classified: DataFrame, top: int = 50) -> DataFrame:
    """Counts of step keys, sources, the most frequent tool names and step-list lengths."""
    typed, maps = F.from_json("steps", STEP_SCHEMA), F.from_json("steps", "array<map<string,string>>")
    usable = evaluate_once(classified.where("usable").select("steps", "n_steps"), typed=typed, maps=maps)
    # all of a row's values side by side, so that a row is parsed once
    values = F.array_compact(
        F.concat(
            F.transform(F.flatten(F.transform("maps", lambda m: F.map_keys(m))), lambda k: _valued("key", k)),
            F.transform("typed", lambda s: _valued("src", F.coalesce(s["src"], F.lit("None")))),
            F.transform(F.flatten(F.transform("typed", lambda s: F.coalesce(s["tools"]["fn"], F.array().cast("array<string>")))), lambda f: F.when(f.isNotNull(), _valued("tool", f))),
            F.array(_valued("length", F.col("n_steps").cast("string"))),
        )
    )
    counts = materialize(usable.select(F.inline(values)).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")), "steps")
    tool = F.col("kind") == "tool"
    return counts.where(~tool).unionByName(counts.where(tool).orderBy(F.desc("n"), "value").limit(top))


def _valued(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"))


def step_quality(classified: DataFrame) -> DataFrame:
    """Missing fields and first-step oddities over usable trials."""
    steps = parsed_steps(classified)
    first = F.col("pos") == 0
    has_msg = F.array_contains("keys", "msg")
    return steps.agg(
        F.count(F.lit(1)).alias("steps"),
        F.count_if(F.col("step.msg").isNull()).alias("null_msg"),
        F.count_if(F.col("step.obs").isNull()).alias("null_obs"),
        F.count_if(F.col("step.tools").isNull()).alias("null_tools"),
        F.count_if(first & (F.col("step.src") == "user") & F.lower("step.msg").contains("warmup")).alias("warmup_first"),
        F.count_if(first & has_msg & (F.coalesce("step.msg", F.lit("")) == "")).alias("empty_first_msg"),
    )


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, q: float) -> DataFrame:
    """Quantile at sorted position round(q * (n - 1)), from counts per distinct value.

    Sorting and cumulating happen on distinct values with their counts, not on rows.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumns({"upto": F.sum("n").over(order), "total": F.sum("n").over(Window.partitionBy(*by))})
    target = F.rint(F.lit(q) * (F.col("total") - 1)) + 1
    return upto.where(F.col("upto") >= target).groupBy(*by).agg(F.min(value).alias("nearest_rank"))


def missingness_audit(counts: DataFrame) -> DataFrame:
    """Are usable rows missing more often for successes than for failures, per model?"""
    per_task = counts.groupBy("model", "task_name").agg(
        *[F.sum(c).alias(c) for c in ("all_trials", "usable", "successes", "failures", "successes_all", "failures_all")]
    )
    cell = F.when(F.col("usable") > 0, F.col("usable"))
    audit = per_task.groupBy("model").agg(
        *[F.sum(c).alias(c) for c in ("all_trials", "usable", "successes", "failures", "successes_all", "failures_all")],
        F.count(cell).alias("unique_tasks"),
        F.avg(cell).alias("trials_per_task_mean"),
        F.median(cell).alias("trials_per_task_median"),
        F.min(cell).alias("trials_per_task_min"),
        F.max(cell).alias("trials_per_task_max"),
    )
    s, f = stats.ratio("successes", "successes_all"), stats.ratio("failures", "failures_all")
    audit = audit.withColumns(
        {
            "usable_fraction": stats.ratio("usable", "all_trials"),
            "success_usable_fraction": s,
            "failure_usable_fraction": f,
            "missingness_gap": F.abs(s - f),
        }
    )
    rules = [
        ("USABLE_LT_100", F.col("usable") < fixed.COMBO_MIN_USABLE),
        ("SUCCESS_USABLE_LT_20", F.col("successes") < fixed.COMBO_MIN_SUCCESSES),
        ("FAILURE_USABLE_LT_20", F.col("failures") < fixed.COMBO_MIN_FAILURES),
        ("USABLE_FRACTION_LT_0.60", F.coalesce(F.col("usable_fraction") < fixed.MIN_USABLE_FRACTION, F.lit(True))),
        ("MISSINGNESS_GAP_GT_0.20", F.coalesce(F.col("missingness_gap") > fixed.MAX_MISSINGNESS_GAP, F.lit(True))),
    ]
    return audit.withColumn("ineligible_reasons", failed_rules(rules)).withColumn(
        "eligible", F.col("ineligible_reasons") == ""
    )


def controlled_pairs(counts: DataFrame, combos: DataFrame) -> DataFrame:
    """Pairs of eligible combinations that share a model or a scaffold, with their common tasks.

    The OR of the two conditions is two equi joins; a pair cannot satisfy both, since it would be
    the same combination twice. The task join is an equi join on (model, scaffold, task).
    """
    keys = combos.where("eligible").select("model", "agent")
    cells = counts.where(F.col("usable") > 0).join(keys, ["model", "agent"], "left_semi").select(
        "model", "agent", "task_name", "usable"
    )

    def pairs(same: str, other: str, relation: str) -> DataFrame:
        a = keys.select(F.col(same), F.col(other).alias("x"))
        b = keys.select(F.col(same), F.col(other).alias("y"))
        both = a.join(b, same).where(F.col("x") < F.col("y"))
        shape = {same: (F.col(same), F.col(same)), other: (F.col("x"), F.col("y"))}
        return both.select(
            shape["model"][0].alias("model_a"),
            shape["agent"][0].alias("agent_a"),
            shape["model"][1].alias("model_b"),
            shape["agent"][1].alias("agent_b"),
            F.lit(relation).alias("relation"),
        )

    every = pairs("model", "agent", "SAME_MODEL").unionByName(pairs("agent", "model", "SAME_SCAFFOLD"))
    side = lambda s: cells.select(
        F.col("model").alias(f"model_{s}"), F.col("agent").alias(f"agent_{s}"), "task_name", F.col("usable").alias(f"n_{s}")
    )
    matched = every.join(side("a"), ["model_a", "agent_a"]).join(side("b"), ["model_b", "agent_b", "task_name"])
    ids = ["model_a", "agent_a", "model_b", "agent_b", "relation"]
    sums = matched.groupBy(*ids).agg(
        F.count(F.lit(1)).alias("common_tasks"), F.sum(F.least("n_a", "n_b")).alias("matched_trials")
    )
    full = every.join(sums, ids, "left").fillna(0, ["common_tasks", "matched_trials"])
    return full.withColumns({f"ge{n}": F.col("common_tasks") >= n for n in (30, 40, 50, 70)})


def crossed_groups(combos: DataFrame, group: str, member: str) -> DataFrame:
    """Eligible partners of each model (or scaffold), and whether they are enough to cross."""
    return combos.where("eligible").groupBy(group).agg(
        F.count(F.lit(1)).alias("members"),
        F.array_join(F.array_sort(F.collect_set(member)), "|").alias("member_list"),
        (F.count(F.lit(1)) >= fixed.CROSSED_MIN).alias("crossed"),
    )


def trial_multiplicity(counts: DataFrame) -> DataFrame:
    n = F.when(F.col("usable") > 0, F.col("usable"))
    return counts.groupBy("model", "agent").agg(
        F.count(n).alias("cells"),
        F.coalesce(F.sum(n), F.lit(0)).alias("trials"),
        F.avg(n).alias("per_cell_mean"),
        F.median(n).alias("per_cell_median"),
        F.min(n).alias("per_cell_min"),
        F.max(n).alias("per_cell_max"),
        F.count_if(n == 1).alias("cells_1"),
        F.count_if(n.between(2, 4)).alias("cells_2_4"),
        F.count_if(n.between(5, 9)).alias("cells_5_9"),
        F.count_if(n >= 10).alias("cells_10_plus"),
    )


def design_connectivity(pairs: DataFrame, combos: DataFrame) -> DataFrame:
    """Members, pairs and common-task spread of each group of both designs."""
    out = None
    for design, relation, group, member, col in (
        ("MODEL_CONTROLLED", "SAME_MODEL", "model", "agent", "model_a"),
        ("SCAFFOLD_CONTROLLED", "SAME_SCAFFOLD", "agent", "model", "agent_a"),
    ):
        own = pairs.where(F.col("relation") == relation).groupBy(F.col(col).alias("group_name")).agg(
            F.count(F.lit(1)).alias("pairs"),
            F.median("common_tasks").alias("common_median"),
            F.min("common_tasks").alias("common_min"),
            F.max("common_tasks").alias("common_max"),
        )
        members = combos.where("eligible").groupBy(F.col(group).alias("group_name")).agg(
            F.count(F.lit(1)).alias("members"),
            F.min(F.least("success_rate", 1 - F.col("success_rate"))).alias("min_balance"),
            F.avg("usable_fraction").alias("mean_usable_fraction"),
            F.avg("usable_trials").alias("mean_usable_trials"),
        )
        part = (
            members.where(F.col("members") >= 2)
            .join(own, "group_name")
            .select(F.lit(design).alias("design"), "*", (F.col("members") >= fixed.CROSSED_MIN).alias("crossed"))
        )
        out = part if out is None else out.unionByName(part)
    return out


def connectivity_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.count(F.lit(1)).alias("pairs"),
        *[F.count_if(f"ge{n}").alias(f"pairs_ge{n}") for n in (30, 40, 50, 70)],
        F.median("common_tasks").alias("common_median"),
        F.min("common_tasks").alias("common_min"),
        F.max("common_tasks").alias("common_max"),
    )


def rank_designs(connectivity: DataFrame) -> DataFrame:
    """Best crossed group of each design by size, overlap, balance and completeness."""
    order = Window.partitionBy("design").orderBy(
        F.desc("members"), F.desc_nulls_last("common_median"), F.desc("min_balance"), F.desc("mean_usable_fraction"), "group_name"
    )
    return connectivity.where("crossed").withColumn("position", F.row_number().over(order)).where(F.col("position") == 1)


def scaffold_followup(combos: DataFrame, pairs: DataFrame, model: str, required: Sequence[str]) -> DataFrame:
    """Metadata of one model over a required list of scaffolds; are all of them available?"""
    one = combos.where(F.col("model") == model)
    wanted = one.where(F.col("agent").isin(*required))
    present = Window.partitionBy("model")
    partners = pairs.where((F.col("relation") == "SAME_MODEL") & (F.col("model_a") == model)).select(
        F.explode(F.array("agent_a", "agent_b")).alias("agent"), "common_tasks"
    ).groupBy("agent").agg(F.count(F.lit(1)).alias("pairs"))
    return (
        wanted.withColumn("all_available", F.count(F.lit(1)).over(present) == len(required))
        .join(partners, "agent", "left")
        .select(
            "model", "agent", "all_trials", "usable_trials", "usable_fraction", "unique_tasks", F.coalesce("pairs", F.lit(0)).alias("pairs"), "all_available"
        )
    )


def feasibility_gate(profile: DataFrame, combos: DataFrame, models: DataFrame, agents: DataFrame, pairs: DataFrame) -> DataFrame:
    """Seven checks on corpus, combinations, crossing and overlap."""
    from stopwise.operators import gates

    wide = gates.one_row(
        [
            gates.facts(profile, [], ["rows", "rows_with_steps", "reward_missing", "reward_non_binary"]),
            gates.facts(combos.agg(F.count_if("eligible").alias("eligible")), [], ["eligible"]),
            gates.facts(models.agg(F.count_if("crossed").alias("crossed_models")), [], ["crossed_models"]),
            gates.facts(agents.agg(F.count_if("crossed").alias("crossed_agents")), [], ["crossed_agents"]),
            gates.facts(pairs.agg(F.count_if("ge30").alias("pairs_ge30")), [], ["pairs_ge30"]),
        ],
        ["rows", "rows_with_steps", "reward_missing", "reward_non_binary", "eligible", "crossed_models", "crossed_agents", "pairs_ge30"],
    )
    bad = F.col("reward_missing") + F.col("reward_non_binary")
    always = F.lit(1.0)
    checks = [
        ("A_binary_outcome", bad, 0.0, bad == 0),
        ("B_full_steps", F.col("rows_with_steps"), None, F.col("rows_with_steps") >= 0.5 * F.col("rows")),
        ("C_simple_mapping", always, 1.0, F.lit(True)),
        gates.at_least("D_eligible_combos", "eligible", 8),
        ("E_crossed_structure", F.greatest("crossed_models", "crossed_agents"), 2.0, (F.col("crossed_models") >= 2) | (F.col("crossed_agents") >= 2)),
        gates.at_least("F_pairs_common_tasks", "pairs_ge30", 10),
        ("G_no_paid_calls", always, 1.0, F.lit(True)),
    ]

    def label(ok):
        core = ok["A_binary_outcome"] & ok["B_full_steps"] & ok["C_simple_mapping"]
        rest = ok["D_eligible_combos"] & ok["E_crossed_structure"] & ok["F_pairs_common_tasks"] & ok["G_no_paid_calls"]
        return F.when(core & rest, "FEASIBLE").when(core, "PARTIALLY_FEASIBLE").otherwise("BLOCKED")

    return gates.gate(wide, checks, label)


def minimum_models_gate(audit: DataFrame) -> DataFrame:
    from stopwise.operators import gates

    wide = audit.agg(F.count_if("eligible").alias("eligible"))
    checks = [gates.at_least("eligible_models", "eligible", fixed.MIN_MODELS)]
    label = lambda ok: F.when(ok["eligible_models"], "PROCEED_TO_TRAINING").otherwise("INSUFFICIENT_FIXED_SCAFFOLD_MODEL_SUPPORT")
    return gates.gate(wide, checks, label)


def recount_usable(trials: DataFrame) -> DataFrame:
    """Usable rows per model straight from the raw fields, without the classification."""
    fine = F.col("reward").between(0, 1) & (F.json_array_length("steps") > 0)
    return trials.groupBy("model").agg(F.count_if(F.coalesce(fine, F.lit(False))).alias("other"))


def usable_crosscheck(audit: DataFrame, recount: DataFrame) -> DataFrame:
    """Usable counts per model by two routes."""
    joined = audit.select("model", "usable").join(recount, "model", "full_outer")
    return joined.withColumn("match", F.col("usable").eqNullSafe(F.col("other")))


def observed_write(df: DataFrame, name: str, metrics: Mapping[str, Column]) -> tuple[DataFrame, dict]:
    """Write a frame and read it back; the metrics are taken from the rows on their way to the files."""
    seen = Observation(name)
    written = materialize(df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), name)
    return written, seen.get


def recount(df: DataFrame, metrics: Mapping[str, Column], seen: Mapping[str, int]) -> DataFrame:
    """``metric, written, reread, mismatch`` of a table against what was observed when it was written."""
    again = df.agg(*[c.alias(n) for n, c in metrics.items()])
    rows = [F.struct(F.lit(n).alias("metric"), F.lit(seen[n]).cast("bigint").alias("written"), F.col(n).cast("bigint").alias("reread")) for n in metrics]
    return again.select(F.inline(F.array(*rows))).withColumn("mismatch", F.col("reread") - F.col("written"))


def stratified_pick(classified: DataFrame, combos: DataFrame, per_combo: int = 25) -> DataFrame:
    """Successes and failures in turn, the first ``per_combo`` of each eligible combination.

    Each outcome of a combination is first cut to its own leading rows, which the optimizer also
    applies before the shuffle, so a dominant combination sends a few rows only.
    """
    keys = combos.where("eligible").select("model", "agent")
    rows = classified.where("usable").join(keys, ["model", "agent"], "left_semi").select(
        "model", "agent", "reward", "row_key"
    )
    own = Window.partitionBy("model", "agent", "reward").orderBy("row_key")
    leading = rows.withColumn("rn", F.row_number().over(own)).where(F.col("rn") <= per_combo)
    turn = Window.partitionBy("model", "agent").orderBy("rn", F.desc("reward"))
    return leading.withColumn("position", F.row_number().over(turn)).where(F.col("position") <= per_combo)


def diverse_combos(combos: DataFrame, base: int = 6, minimum: int = 3) -> DataFrame:
    """The largest eligible combinations, then further ones until enough models and scaffolds are in.

    A combination that adds neither a new model nor a new scaffold never becomes useful later, so
    the greedy choice is one ordered fold. It runs over the combination table, which has at most
    models x scaffolds entries and no trial rows.
    """
    item = F.struct((-F.col("usable_trials")).alias("size"), "model", "agent")
    listed = combos.where("eligible").agg(F.array_sort(F.collect_list(item)).alias("by_size"))
    key = lambda x: F.struct(x["model"].alias("model"), x["agent"].alias("agent"))
    listed = listed.select(
        F.transform(F.slice("by_size", 1, base), key).alias("chosen"),
        F.array_sort(F.transform("by_size", key)).alias("pool"),
    )
    start = F.struct(
        F.array_distinct(F.transform("chosen", lambda x: x["model"])).alias("models"),
        F.array_distinct(F.transform("chosen", lambda x: x["agent"])).alias("agents"),
        F.col("chosen").alias("chosen"),
    )

    def step(acc, x):
        open_ = (F.size(acc["models"]) < minimum) | (F.size(acc["agents"]) < minimum)
        new = ~F.array_contains(acc["models"], x["model"]) | ~F.array_contains(acc["agents"], x["agent"])
        added = F.struct(
            F.array_union(acc["models"], F.array(x["model"])).alias("models"),
            F.array_union(acc["agents"], F.array(x["agent"])).alias("agents"),
            F.array_append(acc["chosen"], x).alias("chosen"),
        )
        return F.when(open_ & new, added).otherwise(acc)

    return listed.select(F.posexplode(F.aggregate("pool", start, step)["chosen"]).alias("position", "c")).select(
        (F.col("position") + 1).alias("position"), "c.model", "c.agent"
    )


#: Columns that every prefix table has.
PREFIX_COLUMNS = ("traj_id", "instance_id", "model_id", "label", "prefix_step_idx", "n_steps_total")


def sample_constraints(sample: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Is a sample broad enough, has its prefix table the required columns, and every run one prefix more than steps?

    Prefixes are counted as they are: rows per run, each index 0 .. n once.
    """
    broad = sample.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("model", "agent").alias("combos"),
        F.count_distinct("model").alias("models"),
        F.count_distinct("agent").alias("agents"),
        F.count_distinct("reward").alias("labels"),
    )
    present = sum(c in prefixes.columns for c in PREFIX_COLUMNS)
    per_run = prefixes.groupBy("traj_id").agg(
        F.count(F.lit(1)).alias("rows"), F.size(F.collect_set("prefix_step_idx")).alias("steps"), F.max("n_steps_total").alias("n"), F.max("prefix_step_idx").alias("last")
    )
    whole = (F.col("rows") == F.col("n") + 1) & (F.col("steps") == F.col("n") + 1) & (F.col("last") == F.col("n"))
    exact = per_run.agg(F.avg(whole.cast("int")).alias("prefix_rule"), F.lit(present).alias("required_columns"))
    from stopwise.operators import gates

    wide = gates.one_row(
        [gates.facts(broad, [], ["rows", "combos", "models", "agents", "labels"]), gates.facts(exact, [], ["prefix_rule", "required_columns"])],
        ["rows", "combos", "models", "agents", "labels", "prefix_rule", "required_columns"],
    )
    checks = [
        gates.at_least("rows", "rows", 100),
        gates.at_least("combos", "combos", 5),
        gates.at_least("models", "models", 3),
        gates.at_least("agents", "agents", 3),
        gates.at_least("labels", "labels", 2),
        gates.at_least("prefix_rule", "prefix_rule", 1),
        gates.at_least("required_columns", "required_columns", len(PREFIX_COLUMNS)),
    ]
    return gates.gate(wide, checks, lambda ok: F.when(gates._all(ok), "PASS").otherwise("FAIL"))
