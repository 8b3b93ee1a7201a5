"""Mixing sources to target weights by hierarchical budgets.

The corpus is a tree of domain, language and source. A total token budget starts at the root; every
node splits its budget among its children by weight. A child takes at most what it can supply (its
tokens times ``max_epochs``); what it can't use goes to its siblings by weight until they are full,
and only what a whole family can't use goes back to the level above. That is water filling: inside
a family a budget b is shared as min(supply, level * weight) with one level for all, found in closed
form from running sums over the children sorted by supply / weight.

Each leaf then takes whole documents in the order of a seeded hash, epoch by epoch: all of the
epochs that fit whole, then the shortest prefix of the next epoch's order that reaches the budget.
The prefix is found in two steps, so no leaf is sorted in one task: token sums per hash slice first,
then an ordered running sum inside the one slice where the budget is met.

Main path: DataFrame functions only. Tables over nodes have one row per leaf; documents are reduced
to (leaf, hash, tokens) before any of this, and texts are never shuffled: a document is chosen by
comparing its hash with its leaf's cut.

Defined results: a null domain, language or source is a branch of its own; a null or empty text has
no tokens, costs no budget and is kept when its hash lies in the prefix; a leaf without weight has
weight 1; non-positive weights give nothing. Rows with equal ids, or equal hashes, lie at the same
place of the order and are taken or left together. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopwise.session import materialize

LEVELS = ("domain", "lang_key", "source_key")
#: Hash slices of a leaf: a power of two; the slice where a leaf's budget is met is sorted in one task.
SLICES = 4096
TOKEN = r"[^\x20\x09-\x0D]+"


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def weight_of(values: Column, weights: Mapping[str, float] | None) -> Column:
    """Weight by value of a level; 1 where none is given."""
    out = F.lit(1.0)
    for value, weight in (weights or {}).items():
        out = F.when(values == value, F.lit(float(weight))).otherwise(out)
    return out


def _share(nodes: DataFrame, family: list[str], name: str) -> DataFrame:
    """Fill one level: ``nodes`` has ``supply``, ``weight`` and the parent's ``budget``; adds column ``name``.

    Sorted by supply / weight, the first k children are full. With S the supply of those before a
    child and W the weight of it and those after, it stays below its supply when
    (budget - S) / W <= supply / weight; the first such child gives the level.
    """
    ratio = F.when(F.col("weight") > 0, F.col("supply") / F.col("weight"))
    order = Window.partitionBy(*family).orderBy(F.col("_ratio").asc_nulls_first(), *[F.col(c) for c in LEVELS if c in nodes.columns])
    whole = Window.partitionBy(*family)
    used = F.when(F.col("weight") > 0, F.col("supply")).otherwise(0.0)
    mass = F.greatest(F.col("weight"), F.lit(0.0))
    ranked = (
        nodes.withColumn("_ratio", ratio)
        .withColumn("_before", F.sum(used).over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_after", F.sum(mass).over(order.rowsBetween(0, Window.unboundedFollowing)))
    )
    here = (F.col("budget") - F.coalesce("_before", F.lit(0.0))) / F.col("_after")
    ranked = ranked.withColumn("_here", F.when((F.col("weight") > 0) & (here <= F.col("_ratio")), here))
    # the level of the first child that is not full; null when all are
    ranked = ranked.withColumn("_level", F.max("_here").over(whole))
    got = F.when(F.col("weight") <= 0, 0.0).when(F.col("_level").isNull(), F.col("supply"))
    got = got.otherwise(F.least(F.col("supply"), F.col("_level") * F.col("weight")))
    return ranked.withColumn(name, got).drop("_ratio", "_before", "_after", "_here", "_level", "budget", "weight", "supply")


def budgets(leaves: DataFrame, total: float, weights: Mapping[str, Mapping[str, float]], max_epochs: int) -> DataFrame:
    """``LEVELS, tokens, budget`` per leaf; ``leaves`` has LEVELS and ``tokens`` (one row per leaf)."""
    supply = F.col("tokens").cast("double") * max_epochs
    by_source = leaves.withColumn("supply", F.when(weight_of(F.col("source_key"), weights.get("source")) > 0, supply).otherwise(0.0))
    by_lang = by_source.groupBy("domain", "lang_key").agg(F.sum("supply").alias("supply"))
    by_lang = by_lang.withColumn("supply", F.when(weight_of(F.col("lang_key"), weights.get("lang")) > 0, F.col("supply")).otherwise(0.0))
    by_domain = by_lang.groupBy("domain").agg(F.sum("supply").alias("supply"))
    top = by_domain.withColumn("weight", weight_of(F.col("domain"), weights.get("domain"))).withColumn("budget", F.lit(float(total)))
    top = _share(top.withColumn("_root", F.lit(0)), ["_root"], "budget_").select("domain", F.col("budget_").alias("budget"))
    mid = by_lang.join(top, "domain").withColumn("weight", weight_of(F.col("lang_key"), weights.get("lang")))
    mid = _share(mid, ["domain"], "budget_").select("domain", "lang_key", F.col("budget_").alias("budget"))
    low = by_source.join(mid, ["domain", "lang_key"]).withColumn("weight", weight_of(F.col("source_key"), weights.get("source")))
    return _share(low, ["domain", "lang_key"], "budget_").select(*LEVELS, "tokens", F.col("budget_").alias("budget"))


def _place(id_col: str, seed: int, epoch: Column) -> Column:
    """Place of a document in an epoch's order: the first 60 bits of a digest."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.col(id_col).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    share: float = 1.0,
    weights: Mapping[str, Mapping[str, float]] | None = None,
    max_epochs: int = 1,
    seed: int = 7,
    domain: Column | None = None,
    id_col: str = "doc_id",
    epoch_col: str | None = "_epoch",
) -> DataFrame:
    """The chosen rows of ``docs`` with all their columns, and their epoch (from 0) as ``epoch_col``.

    Where ``docs`` has a column of that name, the epoch's gets underscores in front until it is free;
    with None there is no such column.

    share: the budget as a part of all tokens there are. weights: per level (domain, lang, source)
    a map from value to weight. domain: how the domain follows from a row's columns.
    """
    chosen, _ = choose(docs, share, weights, max_epochs, seed, domain, id_col, epoch_col)
    return chosen


def free_name(docs: DataFrame, name: str) -> str:
    taken = {column.lower() for column in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def choose(
    docs: DataFrame,
    share: float,
    weights: Mapping[str, Mapping[str, float]] | None,
    max_epochs: int,
    seed: int,
    domain: Column | None,
    id_col: str = "doc_id",
    epoch_col: str | None = "_epoch",
) -> tuple[DataFrame, DataFrame]:
    """``mix``'s rows, and the leaf table: LEVELS, tokens, budget, taken_epochs, cut."""
    domain = F.lit("all") if domain is None else domain
    missing = F.lit("\x00")
    keys = [
        F.coalesce(domain.cast("string"), missing).alias("domain"),
        F.coalesce(F.col("lang").cast("string"), missing).alias("lang_key"),
        F.coalesce(F.col("source").cast("string"), missing).alias("source_key"),
    ]
    sizes = materialize(docs.select(*keys, F.col(id_col).alias("_id"), tokens_of(F.col("text")).alias("n")), "sizes")
    leaves = sizes.groupBy(*LEVELS).agg(F.sum("n").alias("tokens"))
    total = (leaves.agg(F.sum("tokens")).first()[0] or 0) * share
    plan = budgets(leaves, total, weights or {}, max_epochs)
    # whole epochs, and what is left for the prefix of the next
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens") + 1e-9)).otherwise(F.lit(0))
    plan = plan.withColumn("taken_epochs", epochs.cast("int"))
    rest = F.when(F.col("tokens") > 0, F.col("budget") - F.col("taken_epochs") * F.col("tokens")).otherwise(0.0)
    plan = materialize(plan.withColumn("rest", F.when(rest > 0.5, rest).otherwise(0.0)), "plan")
    # the slice in which the prefix ends
    width = (1 << 60) // SLICES
    open_leaves = plan.where("rest > 0").select(*LEVELS, "taken_epochs", "rest")
    placed = sizes.join(open_leaves, [*LEVELS]).withColumn("place", _place("_id", seed, F.col("taken_epochs")))
    placed = placed.withColumn("slice", F.floor(F.col("place") / F.lit(width)).cast("int"))
    sums = placed.groupBy(*LEVELS, "slice").agg(F.sum("n").alias("n"), F.max("rest").alias("rest"))
    running = Window.partitionBy(*LEVELS).orderBy("slice")
    sums = sums.withColumn("upto", F.sum("n").over(running))
    ends = sums.where("upto >= rest AND upto - n < rest").select(*LEVELS, "slice", (F.col("upto") - F.col("n")).alias("offset"))
    inside = placed.join(ends, [*LEVELS, "slice"]).groupBy(*LEVELS, "place").agg(
        F.sum("n").alias("n"), F.max("rest").alias("rest"), F.max("offset").alias("offset")
    )
    upto = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("place")) + F.col("offset")
    cuts = inside.withColumn("upto", upto).where("upto >= rest").groupBy(*LEVELS).agg(F.min("place").alias("cut"))
    plan = materialize(plan.join(cuts, [*LEVELS], "left"), "cuts")
    # rows travel as one struct, so their own column names can't clash with the ones used here
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_id"), *keys)
    joined = keyed.join(plan.select(*LEVELS, F.col("taken_epochs").alias("whole"), "cut"), [*LEVELS])
    last = F.when(_place("_id", seed, F.col("whole")) <= F.col("cut"), F.col("whole") + 1).otherwise(F.col("whole"))
    chosen = joined.select("row", F.explode(F.sequence(F.lit(0), last)).alias("_epoch"), last.alias("last")).where("_epoch < last")
    epoch = [F.col("_epoch").alias(free_name(docs, epoch_col))] if epoch_col else []
    # named one by one: a column of the documents may be called like one of these
    return chosen.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], *epoch), plan
