"""Dual heads on fold-local features: named vectors, boosted trees cut at their best iteration, sigmoid calibration.

Encoders and calibrators work on all folds at once; what they learn is a small table keyed by fold. The
trees are one distributed fit per fold and head; the fits run side by side in scheduler pools.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopwise import fixed
from stopwise.functions import stats
from stopwise.session import materialize, shared_dir

MISSING = "__MISSING__"
#: Fits that run side by side.
POOLS = 4


# ---- named vectors -----------------------------------------------------------------------------

def _after(prefix: str) -> Callable[[Column], Column]:
    return lambda value: F.concat(F.lit(prefix), value.cast("string"))


def _is(column: str) -> Callable[[Column], Column]:
    return lambda value: (value == F.col(column)).cast("double")


def encoder_state(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], blocks: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Per fold: ``names`` of the vector's places in order, and the values of each category (``<c>_values``).

    Categories come from the fold's train rows, with a place for missing and unseen values. ``blocks``
    have ``fold`` and ``width``: the number of places of each block of vectors.
    """
    seen = lambda c: F.collect_set(F.when(F.col("role") == "train", F.col(c)))
    values = [F.array_sort(F.array_union(seen(c), F.array(F.lit(MISSING)))).alias(f"{c}_values") for c in categorical]
    train = rows.groupBy("fold").agg(F.count_if(F.col("role") == "train").alias("train_rows"), *values)
    names: list[Column] = [F.array(*[F.lit(n) for n in numeric]).cast("array<string>")]
    names += [F.transform(f"{c}_values", _after(f"{c}=")) for c in categorical]
    for block, widths in (blocks or {}).items():
        width = F.coalesce(f"{block}_width", F.lit(0))
        train = train.join(widths.select("fold", F.col("width").alias(f"{block}_width")), "fold", "left").withColumn(f"{block}_width", width)
        places = F.transform(F.sequence(F.lit(1), F.col(f"{block}_width")), _after(f"{block}_"))
        names.append(F.when(F.col(f"{block}_width") > 0, places).otherwise(F.array().cast("array<string>")))
    return train.withColumn("names", F.concat(*names))


def assemble(
    rows: DataFrame, state: DataFrame, numeric: Sequence[str], categorical: Sequence[str], blocks: Mapping[str, DataFrame] | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """``rows`` with ``features array<double>``, whose places are ``state.names``.

    ``blocks`` hold ``fold``, the ``keys`` and ``score``; a row without one has zeros there.
    """
    joined = rows.join(state, "fold")
    parts = [F.array(*[F.col(c).cast("double") for c in numeric])]
    parts += [F.transform(f"{c}_values", _is(c)) for c in categorical]
    for block, scores in (blocks or {}).items():
        joined = joined.join(scores.select("fold", *keys, F.col("score").alias(f"{block}_score")), ["fold", *keys], "left")
        parts.append(F.coalesce(f"{block}_score", F.array_repeat(F.lit(0.0), F.col(f"{block}_width"))))
    joined = joined.withColumn("features", F.concat(*parts))
    return joined.drop("train_rows", *[f"{c}_values" for c in categorical], *[f"{b}{s}" for b in blocks or () for s in ("_width", "_score")])


def row_digest(keys: Sequence[str | Column], value: Column) -> Column:
    """Digest of a set of (key, value) rows in any order; equal multisets have equal digests."""
    return F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.bit_xor(F.xxhash64(*keys, value)).cast("string"), F.sum(F.pmod(F.xxhash64(value, *keys), F.lit(1 << 31))).cast("string"))


def alignment(source: DataFrame, assembled: DataFrame, keys: Sequence[str], first: str) -> DataFrame:
    """Per fold: vector widths against the names, and whether rows and vectors still belong together.

    ``first`` is the column of ``source`` that the vector's first place holds.
    """
    own = source.groupBy("fold").agg(row_digest(keys, F.col(first).cast("double")).alias("expected"))
    width = F.size("features")
    found = assembled.groupBy("fold").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(width).alias("least_width"),
        F.max(width).alias("most_width"),
        F.max(F.size("names")).alias("names"),
        row_digest(keys, F.get("features", F.lit(0))).alias("got"),
    )
    joined = own.join(found, "fold", "full_outer")
    fits = (F.col("least_width") == F.col("names")) & (F.col("most_width") == F.col("names"))
    return joined.select("fold", "rows", "least_width", "most_width", "names", F.coalesce(fits, F.lit(False)).alias("width_ok"), F.coalesce(F.col("expected") == F.col("got"), F.lit(False)).alias("aligned"))


# ---- boosted trees -----------------------------------------------------------------------------

@dataclass
class Head:
    """A fitted head: its trees up to the best iteration, and the validation loss of each iteration."""

    model: GBTClassificationModel
    curve: list[float]
    best_iteration: int


def cut(model: GBTClassificationModel, trees: int) -> GBTClassificationModel:
    """The model of the first ``trees`` iterations."""
    from pyspark import SparkContext

    java, context = model._java_obj, SparkContext._active_spark_context
    jvm, gateway = context._jvm, context._gateway
    kept = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, trees)
    weights = gateway.new_array(jvm.double, trees)
    for i in range(trees):
        kept[i], weights[i] = java.trees()[i], java.treeWeights()[i]
    shorter = jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), kept, weights, java.numFeatures(), java.numClasses())
    out = GBTClassificationModel(shorter)
    out._resetUid(model.uid)
    return out.setFeaturesCol("features")


def train_head(rows: DataFrame, target: str, trees: int = 20, depth: int = 3, seed: int = fixed.SEED) -> Head:
    """Boosted trees on the train rows; the validation loss of every iteration decides where the model is cut."""
    gbt = GBTClassifier(labelCol=target, featuresCol="features", weightCol="sample_weight", maxIter=trees, maxDepth=depth, seed=seed, cacheNodeIds=False)
    whole = gbt.fit(rows.where(F.col("role") == "train"))
    valid = rows.where(F.col("role") == "valid")
    curve = [float(loss) for loss in whole.evaluateEachIteration(valid)]
    best = int(np.argmin(curve)) + 1 if curve and np.isfinite(curve).all() else len(whole.trees)
    return Head(cut(whole, best), curve, best)


def pack(rows: DataFrame, copies: str = "copies") -> DataFrame:
    """Distinct rows with their number; weighted fits and sums don't tell them from the rows."""
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias(copies))


def train_dual_heads(rows: DataFrame, fold_names: Sequence[str], keys: Sequence[str], trees: int = 20) -> tuple[DataFrame, list[tuple[str, str, int, int]]]:
    """``fold, role, keys, head, target, sample_weight, prob, prob_cal`` of every row, and (fold, head, trees, best iteration).

    ``rows`` carry features, role, sample_weight (of packed rows: of all copies) and ``target_<head>``. Fits
    run side by side, each in a scheduler pool of its own; a fit reads its fold's files only.
    """
    spark = rows.sparkSession
    path = shared_dir(spark, "folds")
    rows.withColumn("_fold", F.col("fold")).write.partitionBy("_fold").parquet(path)
    stored = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_fold", T.StringType())])).parquet(path)
    of = lambda fold: stored.where(F.col("_fold") == fold).drop("_fold").withColumn("features", array_to_vector("features"))

    def fit(job: tuple[str, str]) -> tuple[str, str, Head]:
        fold, head = job
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{fold}-{head}")
        return fold, head, train_head(of(fold), f"target_{head}", trees)

    jobs = [(fold, head) for fold in fold_names for head in fixed.HEADS]
    with ThreadPoolExecutor(POOLS) as threads:
        fitted = list(threads.map(inheritable_thread_target(spark)(fit), jobs))
    scored = None
    for fold, head, own in fitted:
        part = own.model.transform(of(fold)).select(
            "fold", "role", *keys, F.lit(head).alias("head"), F.col(f"target_{head}").cast("double").alias("target"), "sample_weight", vector_to_array("probability")[1].alias("prob")
        )
        scored = part if scored is None else scored.unionByName(part)
    scored = materialize(scored, "scored")
    lines = fit_platt(platt_input(scored, ["fold", "head"], "prob", "target", "sample_weight"), ["fold", "head"])
    calibrated = apply_platt(scored, lines, ["fold", "head"], "prob", "prob_cal")
    return calibrated, [(fold, head, len(own.curve), own.best_iteration) for fold, head, own in fitted]


# ---- sigmoid calibration -----------------------------------------------------------------------

def platt_input(rows: DataFrame, keys: Sequence[str], score: str, target: str, weight: str) -> DataFrame:
    """Valid rows packed to one weighted row per distinct score and target: ``keys, z, y, w``.

    Equal rows add their weights, which leaves the fit unchanged and shrinks its input to the
    distinct scores.
    """
    packed = rows.where(F.col("role") == "valid").groupBy(*keys, score, target).agg(F.sum(weight).alias("w"))
    return packed.select(*keys, stats.logit(score).alias("z"), F.col(target).cast("double").alias("y"), "w")


def fit_platt(packed: DataFrame, keys: Sequence[str], rounds: int = 50, tolerance: float = 1e-13) -> DataFrame:
    """``keys, slope, intercept``: weighted maximum likelihood of a sigmoid on the log odds, for all keys at once.

    A round is one grouped aggregate, whose result (six sums per key) takes one Newton step per key on the
    driver. A step that lowers the likelihood is taken back and halved. Keys of one class or with separable
    scores have no finite optimum; their steps are at most 2 long and end with the rounds.
    """
    spark, keys = packed.sparkSession, list(keys)
    packed = materialize(packed, "platt")
    fields = [packed.schema[k] for k in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", slope double, intercept double"
    start = [tuple(r[k] for k in keys) for r in packed.select(*keys).distinct().collect()]
    lines = {key: np.array([1.0, 0.0]) for key in start}
    steps = {key: np.zeros(2) for key in start}
    best = {key: -np.inf for key in start}
    open_keys = set(start)

    def table(some: Iterable[tuple]) -> DataFrame:
        return spark.createDataFrame([(*k, *map(float, lines[k])) for k in some], schema)

    t = F.col("slope") * F.col("z") + F.col("intercept")
    p = stats.sigmoid(t)
    rest, h = F.col("w") * (p - F.col("y")), F.col("w") * p * (1 - p)
    fit = F.col("w") * (F.col("y") * t - F.greatest(t, F.lit(0.0)) - F.log1p(F.exp(-F.abs(t))))
    for _ in range(rounds):
        if not open_keys:
            break
        sums = packed.join(table(open_keys), keys).groupBy(*keys).agg(
            F.sum("w").alias("n"), F.sum(fit).alias("fit"), F.sum(rest).alias("g0"), F.sum(rest * F.col("z")).alias("g1"),
            F.sum(h).alias("h0"), F.sum(h * F.col("z")).alias("h1"), F.sum(h * F.col("z") * F.col("z")).alias("h2"),
        )
        for r in sums.collect():
            key = tuple(r[k] for k in keys)
            if r["fit"] < best[key] - 1e-12 * abs(best[key]):
                steps[key] /= 2
                lines[key] = lines[key] + steps[key]
                continue
            best[key] = r["fit"]
            gradient = np.array([r["g1"], r["g0"]])
            if np.abs(gradient).max() <= tolerance * r["n"]:
                open_keys.discard(key)
                continue
            step = np.linalg.solve([[r["h2"] + 1e-12 * r["n"], r["h1"]], [r["h1"], r["h0"] + 1e-12 * r["n"]]], gradient)
            steps[key] = step * min(1.0, 2.0 / np.abs(step).max())
            lines[key] = lines[key] - steps[key]
    return table(lines)


def apply_platt(rows: DataFrame, lines: DataFrame, keys: Sequence[str], score: str, name: str) -> DataFrame:
    joined = rows.join(lines, list(keys), "left")
    return joined.withColumn(name, stats.sigmoid(F.col("slope") * stats.logit(score) + F.col("intercept"))).drop("slope", "intercept")


def platt_residuals(packed: DataFrame, lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted mean residual, and mean residual times log odds: both 0 at the optimum."""
    rest = F.col("y") - stats.sigmoid(F.col("slope") * F.col("z") + F.col("intercept"))
    return packed.join(lines, list(keys)).groupBy(*keys).agg(
        F.sum("w").alias("weight"),
        (F.sum(F.col("w") * rest) / F.sum("w")).alias("residual"),
        (F.sum(F.col("w") * rest * F.col("z")) / F.sum("w")).alias("residual_logit"),
    )
