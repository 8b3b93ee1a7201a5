"""Views of the audit's data model over the star-schema tables.

Every view is derived row by row, but for one window over the lines of a run that numbers its steps;
the steps of a run are the unit of the data model and are small against a partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stopwise.session import materialize, spread

# Fixed values of the derived views.
ACTIONS = (
    "pytest -x tests",
    "sed -i s/a/b/ f.py",
    "cat > f.py",
    "ls -la",
    "echo COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT",
    "python -m unittest",
    "git apply fix.diff",
)
LABELS = (
    "claude-opus@anthropic",
    "gemini-pro@google",
    "grok-code@xai",
    "gpt-mini@openai",
    "qwen-coder@alibaba",
    "minimax-m2@openai",
    "kimi-k2@moonshot",
    "local-model",
)
SCAFFOLDS = ("terminal", "minimal", "handsfree", "coder")


class Tables:
    """Lazy views over one data directory."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self._built: dict[str, DataFrame] = {}

    def once(self, name: str, build: Callable[[], DataFrame], keep: bool = False) -> DataFrame:
        """Build a frame once per query; with ``keep`` its rows are also written once."""
        if name not in self._built:
            df = build()
            self._built[name] = materialize(df, name) if keep else df
        return self._built[name]

    def read(self, name: str) -> DataFrame:
        return self.once(f"table:{name}", lambda: self.spark.read.parquet(f"{self.path}/{name}.parquet"))

    def read_spread(self, name: str, key: str) -> DataFrame:
        return self.once(f"spread:{name}", lambda: spread(self.read(name), key))

    def runs(self) -> DataFrame:
        """One row per run: who ran which task, and how it ended."""
        urgency = F.substring("o_orderpriority", 1, 1).cast("int")
        resolved = (
            F.when(F.col("o_orderstatus") == "F", 1)
            .when(F.col("o_orderstatus") == "O", F.when(F.col("o_orderkey") % 6 >= urgency, 1).otherwise(0))
            .otherwise(F.when(F.col("o_orderkey") % 4 != 0, 1).otherwise(0))
        )
        return self.read("orders").select(
            F.col("o_orderkey").alias("traj_id"),
            F.concat(F.lit("task-"), F.lpad((F.col("o_custkey") % 60).cast("string"), 2, "0")).alias("instance_id"),
            F.col("o_orderpriority").alias("model_id"),
            resolved.alias("resolved"),
        )

    def _lines(self) -> DataFrame:
        """Every line of a run as one step, numbered in a total order (line numbers repeat)."""
        flag = F.col("l_returnflag")
        order = Window.partitionBy("l_orderkey").orderBy(
            "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
            "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        )
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("traj_id"),
            (F.row_number().over(order) - 1).alias("prefix_step_idx"),
            (F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")) - 1).cast("int").alias("n_steps_total"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_discount").alias("discount"),
            F.col("l_tax").alias("min_tax"),
            (flag == "A").alias("test_pass"),
            (flag == "R").alias("test_fail"),
            ((F.col("l_linestatus") == "O") & (F.col("l_tax") >= 0.07)).alias("traceback"),
        )

    def lines(self) -> DataFrame:
        """Numbered lines, written once per query: predictions and steps are both read from them.

        Columns are named anew at every call, so that two views can be joined.
        """
        kept = self.once("lines", self._lines, keep=True)
        return kept.select(*[F.col(c).alias(c) for c in kept.columns])

    def preds(self) -> DataFrame:
        """One row per scored prefix: two head scores."""
        return self.lines().select(
            "traj_id",
            "prefix_step_idx",
            "n_steps_total",
            F.round(0.5 + F.col("quantity") / 100, 6).alias("p_success"),
            F.round(0.5 + 4.9 * F.col("discount"), 6).alias("p_failure"),
        )

    def preds_shifted(self) -> DataFrame:
        """The same predictions with a tiny change on some runs, for reconciliation."""
        moved = F.when(F.col("traj_id") % 1000 == 0, F.col("p_success") - 1e-9)
        return self.preds().withColumn("p_success", F.coalesce(moved, F.col("p_success")))

    def steps(self) -> DataFrame:
        """One row per executed step, 1-based."""
        texts = F.array(*[F.lit(a) for a in ACTIONS])
        step = F.col("prefix_step_idx") + 1
        return self.lines().select(
            "traj_id",
            step.alias("step_idx"),
            F.get(texts, (F.col("prefix_step_idx") % 7).cast("int")).alias("action_text"),
            F.when(F.col("discount") >= 0.09, F.lit("tee out.log")).alias("tool_args_text"),
            F.when(F.col("min_tax") == 0, F.array(F.lit("test")))
            .otherwise(F.array().cast("array<string>"))
            .alias("action_subtypes"),
            F.col("test_pass").alias("test_pass_seen_this_step"),
            F.col("test_fail").alias("test_fail_seen_this_step"),
            F.col("traceback").alias("traceback_seen_this_step"),
            F.lit(False).alias("tool_error_seen_this_step"),
        )

    def trials(self) -> DataFrame:
        """Wide trial rows with their steps as one JSON string, broken in every way that occurs."""
        key = F.col("o_orderkey")
        step_json = lambda i: F.concat(
            F.lit('{"src":"'),
            F.when(i == 1, "user").otherwise("agent"),
            F.lit('","msg":'),
            F.when((i == 1) & (key % 3 == 0), F.lit('"Warmup run"'))
            .when(i % 4 == 0, F.lit("null"))
            .otherwise(F.concat(F.lit('"note '), i.cast("string"), F.lit(" for order "), (key % 11).cast("string"), F.lit('"'))),
            F.lit(',"tools":'),
            F.when(i == 1, F.lit("null")).otherwise(
                F.concat(
                    F.lit('[{"fn":"'),
                    F.when(i % 2 == 0, "bash").otherwise("editor"),
                    F.lit('","cmd":"'),
                    F.get(F.array(*[F.lit(a) for a in ACTIONS]), ((key + i) % 7).cast("int")),
                    F.lit('"}]'),
                )
            ),
            F.lit(',"obs":'),
            F.when(i % 3 == 0, F.lit("null"))
            .when(i % 3 == 1, F.lit('"3 passed"'))
            .otherwise(F.lit('"1 failed, OK"')),
            F.lit("}"),
        )
        steps_list = F.concat(
            F.lit("["),
            F.array_join(F.transform(F.sequence(F.lit(1), (key % 7 + 1).cast("int")), step_json), ","),
            F.lit("]"),
        )
        kind = key % 20
        steps = (
            F.when(kind == 0, F.lit(None).cast("string"))
            .when(kind == 1, "")
            .when(kind == 2, "null")
            .when(kind == 3, "[bad")
            .when(kind == 4, "{}")
            .when(kind == 5, "[]")
            .otherwise(steps_list)
        )
        resolved = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).otherwise(
            F.when(key % 4 != 0, 1).otherwise(0)
        )
        return self.read_spread("orders", "o_orderkey").select(
            F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("trial-"), key.cast("string"))).alias("trial_id"),
            F.when(key % 6 == 0, "").otherwise(F.concat(F.lit("name-"), key.cast("string"))).alias("trial_name"),
            F.concat(F.lit("task-"), F.lpad((F.col("o_custkey") % 60).cast("string"), 2, "0")).alias("task_name"),
            F.get(F.array(*[F.lit(x) for x in LABELS]), F.pmod(F.col("o_custkey") + F.floor(key / 60), F.lit(8)).cast("int")).alias("model"),
            F.get(F.array(*[F.lit(x) for x in SCAFFOLDS]), F.pmod(F.floor(key / 7), F.lit(4)).cast("int")).alias("agent"),
            F.when(key % 97 == 0, F.lit(None).cast("int")).when(key % 101 == 0, 2).otherwise(resolved).alias("reward"),
            steps.alias("steps"),
            key.alias("row_key"),
        )

    def documents_json(self) -> DataFrame:
        """Raw run documents as JSON text, with every defect the validation knows."""
        key = F.col("o_orderkey")
        turns = (key % 5 + 1).cast("int")
        number = lambda i: i.cast("string")
        call = lambda i: F.concat(
            F.lit('{"id":"c'),
            number(i),
            F.when(
                i % 3 == 1,
                F.concat(
                    F.lit('","function":"bash","arguments":{"command":"'),
                    F.get(F.array(*[F.lit(a) for a in ACTIONS]), ((key + i) % 7).cast("int")),
                    F.lit('"}}'),
                ),
            )
            .when(i % 3 == 0, F.concat(F.lit('","function":{"name":"edit","arguments":{"path":"f'), number(i), F.lit('.py"}}}')))
            .otherwise(F.concat(F.lit('","arguments":"raw '), number(i), F.lit('"}'))),
        )
        turn = lambda i: F.concat(
            F.lit('{"role":"assistant","content":"thought","tool_calls":['),
            call(i),
            F.lit(']},{"role":"tool","content":"'),
            F.when(i % 2 == 0, F.concat(number(i), F.lit(" passed, OK"))).otherwise("1 failed FAILURES"),
            F.lit('"}'),
        )
        turns_text = F.array_join(F.transform(F.sequence(F.lit(1), turns), turn), ",")
        kind = key % 24
        messages = F.when(kind == 2, F.lit("[]")).when(kind == 8, F.lit('[{"role":"user","content":"task"}]')).otherwise(
            F.concat(F.lit('[{"role":"system","content":"rules"},{"role":"user","content":"task"},'), turns_text, F.lit("]"))
        )
        resolved = F.when(kind == 4, "1").when(kind == 5, '"true"').otherwise(F.when(F.col("o_orderstatus") == "F", "true").otherwise("false"))
        docent = F.when(kind == 6, "{}").otherwise(F.concat(F.lit('{"model_label":"'), F.col("o_orderpriority"), F.lit('"}')))
        info = F.concat(F.lit('{"resolved":'), resolved, F.lit(',"docent":'), docent, F.lit(',"submission":"patch"}'))
        whole = F.concat(
            F.lit("{"),
            F.when(kind == 1, "").otherwise(F.concat(F.lit('"instance_id":"inst-'), number(key), F.lit('",'))),
            F.lit('"messages":'),
            messages,
            F.when(kind == 3, "").otherwise(F.concat(F.lit(',"info":'), info)),
            F.lit("}"),
        )
        return self.read_spread("orders", "o_orderkey").select(
            F.concat(F.col("o_orderpriority"), F.lit("/inst-"), number(key), F.lit(".traj.json")).alias("file"),
            F.col("o_orderpriority").alias("model_dir"),
            F.when(kind == 0, "[1]").when(kind == 7, "{bad").otherwise(whole).alias("document"),
        )

    def messages(self) -> DataFrame:
        return self.read("conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))

    def docs(self) -> DataFrame:
        return self.read_spread("documents", "doc_id").select("doc_id", "text", "lang", "source")
