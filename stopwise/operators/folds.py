"""Leave-one-model-out and leave-two-models-out splits, and checks on them.

A split is decided per (model, task) cell. The cell table is small; rows get their roles by one equi
join on the cell, so no fold re-reads the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopwise import fixed
from stopwise.functions import stats


def _names(cells: DataFrame) -> Column:
    """Sorted model names as one scalar array; a dimension's names, never rows."""
    return cells.select("model_id").distinct().agg(F.sort_array(F.collect_list("model_id"))).scalar()


def valid_sample(pool: DataFrame, seed: int, per_task: int = fixed.VALID_MODELS_PER_TASK) -> DataFrame:
    """Per fold and task, min(k, n - 1) of the n training models go to validation."""
    text = F.concat_ws("|", F.lit(str(seed)), "instance_id", "model_id")
    order = Window.partitionBy("fold", "instance_id").orderBy(F.md5(text.cast("binary")), "model_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("fold", "instance_id"))
    picked = F.row_number().over(order) <= F.least(F.lit(per_task), n - 1)
    return pool.withColumn("role", F.when(picked, "valid").otherwise("train"))


def _split(cells: DataFrame, trainable: DataFrame, folds: DataFrame, held: Column, seed: int) -> DataFrame:
    test = folds.where(held).withColumn("role", F.lit("test"))
    pool = folds.where(~held).join(trainable, ["model_id", "instance_id"], "left_semi")
    return test.unionByName(valid_sample(pool, seed))


def lomo_cells(cells: DataFrame, trainable: DataFrame, seed: int = fixed.SEED) -> DataFrame:
    """Role of every (model, task) cell in every leave-one-out fold."""
    folds = cells.select("model_id", "instance_id", F.explode(_names(cells)).alias("fold"))
    return _split(cells, trainable, folds, F.col("model_id") == F.col("fold"), seed)


def pair_cells(cells: DataFrame, trainable: DataFrame, pairs: DataFrame, seed: int = fixed.SEED) -> DataFrame:
    """The same with two held-out models; ``pairs`` has pair_id, agent_a, agent_b."""
    listed = pairs.agg(F.collect_list(F.struct("pair_id", "agent_a", "agent_b"))).scalar()
    folds = cells.select("model_id", "instance_id", F.inline(listed)).withColumnRenamed("pair_id", "fold")
    held = (F.col("model_id") == F.col("agent_a")) | (F.col("model_id") == F.col("agent_b"))
    return _split(cells, trainable, folds, held, seed).drop("agent_a", "agent_b")


def long_enough(runs: DataFrame, minimum: int = fixed.MIN_STEPS_FOR_TRAINING) -> DataFrame:
    """Cells that keep at least one run once short runs are left out of training."""
    return runs.where(F.col("n_steps_total") >= minimum).select("model_id", "instance_id").distinct()


def short_runs(runs: DataFrame, minimum: int = fixed.MIN_STEPS_FOR_TRAINING) -> DataFrame:
    return runs.where(F.col("n_steps_total") < minimum).select("traj_id")


def assign_roles(rows: DataFrame, cells: DataFrame, minimum: int = fixed.MIN_STEPS_FOR_TRAINING) -> DataFrame:
    """Rows with fold and role; short runs stay in test only."""
    joined = rows.join(F.broadcast(cells), ["model_id", "instance_id"])
    return joined.where((F.col("role") == "test") | (F.col("n_steps_total") >= minimum))


def anti_join_short(rows: DataFrame, short: DataFrame) -> DataFrame:
    return rows.join(short, "traj_id", "left_anti")


def split_summary(roles: DataFrame) -> DataFrame:
    return roles.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("runs"), F.count_distinct("model_id").alias("models"), F.avg("resolved").alias("prior")
    )


def fold_leakage(roles: DataFrame, pairs: bool = False) -> DataFrame:
    """Is a held-out model in train or valid, and does test hold anything else?

    A fold's held-out models are those of its test rows; counts per (fold, model, role) decide.
    """
    counts = roles.groupBy("fold", "model_id").agg(
        *[F.count_if(F.col("role") == r).alias(r) for r in ("train", "valid", "test")]
    )
    held = F.col("test") > 0
    return counts.groupBy("fold").agg(
        F.count_if(held).alias("held_out_models"),
        *[F.sum(r).alias(f"{r}_rows") for r in ("train", "valid", "test")],
        F.bool_or(held & ((F.col("train") > 0) | (F.col("valid") > 0))).alias("leaks"),
        (F.count_if(held) == (2 if pairs else 1)).alias("test_only_held_out"),
    )


def fold_metadata(roles: DataFrame, encoder: DataFrame) -> DataFrame:
    """Rows, feature width, priors and status of each fold; ``encoder`` names the places of its vector."""
    of = lambda r: F.col("role") == r
    summary = roles.groupBy("fold").agg(
        *[F.count_if(of(r)).alias(f"{r}_rows") for r in ("train", "valid", "test")],
        F.avg(F.when(of("train"), F.col("resolved"))).alias("train_prior"),
        F.avg(F.when(of("test"), F.col("resolved"))).alias("test_prior"),
        F.when((F.count_if(of("train")) > 0) & (F.count_if(of("valid")) > 0) & (F.count_if(of("test")) > 0), "FOLD_OK")
        .otherwise("FOLD_FAIL")
        .alias("status"),
    )
    return summary.join(encoder.select("fold", F.size("names").alias("features")), "fold", "left")


def row_index_summary(prefixes: DataFrame) -> DataFrame:
    per_run = prefixes.groupBy("traj_id", "model_id").agg(
        F.count(F.lit(1)).alias("k"), F.sum("label").alias("positives")
    )
    per_model = per_run.groupBy("model_id").agg(
        F.sum("k").alias("k"), F.count(F.lit(1)).alias("runs"), F.sum("positives").alias("positives")
    )
    return per_model.agg(
        F.sum("k").alias("rows"),
        F.sum("runs").alias("runs"),
        F.count(F.lit(1)).alias("models"),
        stats.ratio(F.sum("positives"), F.sum("k")).alias("label_rate"),
    )


def dense_features(
    rows: DataFrame, numeric: Sequence[str], boolean: Sequence[str] = (), categorical: Sequence[str] = ()
) -> DataFrame:
    """Fold-local dense features of rows that carry fold and role.

    Numbers: missing is -1, then standardised by the training rows' mean and population deviation
    (1 where that is 0). Booleans: missing is 0. Categories: missing and unseen become __MISSING__.
    Training statistics are one small row per fold, and one per fold and category.
    """
    filled = rows.withColumns(
        {
            **{c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in numeric},
            **{c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in boolean},
            **{c: F.coalesce(F.col(c), F.lit("__MISSING__")) for c in categorical},
        }
    )
    train = filled.where(F.col("role") == "train")
    moments = train.groupBy("fold").agg(
        *[F.avg(c).alias(f"{c}_mean") for c in numeric], *[F.stddev_pop(c).alias(f"{c}_std") for c in numeric]
    )
    # a handful of fold keys: a shuffle by them would put a fold into one task
    out = filled.join(F.broadcast(moments), "fold", "left")
    for c in numeric:
        scale = F.when(F.col(f"{c}_std") > 0, F.col(f"{c}_std")).otherwise(1.0)
        out = out.withColumn(f"{c}_z", (F.col(c) - F.col(f"{c}_mean")) / scale)
    for c in categorical:
        seen = train.select("fold", c).distinct().withColumn("seen", F.lit(True))
        out = out.join(F.broadcast(seen), ["fold", c], "left").withColumn(
            f"{c}_cat", F.when(F.col("seen"), F.col(c)).otherwise("__MISSING__")
        ).drop("seen")
    return out.drop(*[f"{c}_mean" for c in numeric], *[f"{c}_std" for c in numeric])


def calibration_summary(scored: DataFrame, copies: str | None = None) -> DataFrame:
    """Brier score, log loss and rates per (fold, head, role); scored has p and y, packed rows also ``copies``."""
    p = F.least(F.greatest(F.col("p"), F.lit(fixed.LOGIT_EPS)), F.lit(1 - fixed.LOGIT_EPS))
    y = F.col("y")
    n = F.col(copies) if copies else F.lit(1)
    mean = (lambda c: F.sum(n * c) / F.sum(n)) if copies else F.avg
    return scored.groupBy("fold", "head", "role").agg(
        F.sum(n).alias("n"),
        mean(y).alias("positive_rate"),
        mean(F.col("p")).alias("mean_score"),
        mean((F.col("p") - y) * (F.col("p") - y)).alias("brier"),
        mean(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"),
    )
