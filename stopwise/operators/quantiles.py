"""Exact quantiles of large groups by radix selection.

A double's bits, read as a whole number, keep its order. Each level counts a group's values by the next
few bits, finds the bucket that holds the wanted rank and looks on inside it, so a group of any size is
counts on the map side and at most 4,096 buckets, never a sorted or buffered group. It ends when a
bucket holds one distinct value, after six levels at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopwise.session import materialize

#: Bits below the bucket number at each level.
LEVELS = (52, 40, 28, 16, 4, 0)
_FRACTION = float(1 << 52)


def order_key(value: Column | str) -> Column:
    """A whole number with the order of a double; 0.0 and -0.0 are equal, NaN and NULL have none.

    Built from exponent and fraction by exact operations (scaling by powers of two).
    """
    v = F.col(value) if isinstance(value, str) else value
    size = F.abs(v)
    guess = F.floor(F.log2(size)).cast("int")
    # the logarithm may round across a power of two
    exponent = guess + F.when(F.pow(F.lit(2.0), guess) > size, -1).when(F.pow(F.lit(2.0), guess + 1) <= size, 1).otherwise(0)
    exponent = F.greatest(F.when(F.pow(F.lit(2.0), guess + 1) == F.lit(float("inf")), guess).otherwise(exponent), F.lit(-1022))
    # in two halves, as 2 to the power of 1022 and more would leave the range on the way
    half = F.floor(exponent / 2).cast("int")
    fraction = size / F.pow(F.lit(2.0), half) / F.pow(F.lit(2.0), exponent - half)
    normal = (exponent + 1022).cast("bigint") * F.lit(1 << 52) + (fraction * _FRACTION).cast("bigint")
    key = F.when(size == 0, F.lit(0)).when(size == float("inf"), F.lit(2047 << 52)).otherwise(normal)
    return F.when(v.isNotNull() & ~F.isnan(v), F.when(v < 0, -key).otherwise(key))


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> tuple[DataFrame, Column]:
    """``right`` under other names, and the null-safe condition that the names agree."""
    renamed = right.withColumnsRenamed({n: f"{n}_of" for n in names})
    condition = F.lit(True)
    for n in names:
        condition = condition & F.col(n).eqNullSafe(F.col(f"{n}_of"))
    return renamed, condition


def exact_quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """``by, n, q array<double>``: the quantiles at ``shares``, linear between neighbouring ranks.

    NULL and NaN are left out; a group of nothing else has n = 0 and NULL quantiles.
    """
    by = list(by)
    kept = rows.select(*by, F.col(value).cast("double").alias("v"))
    counts = materialize(kept.groupBy(*by).agg(F.count_if(F.col("v").isNotNull() & ~F.isnan("v")).alias("n")), "counts")
    keyed = materialize(kept.withColumn("key", order_key("v")).where(F.col("key").isNotNull()), "keyed")
    place = [F.lit(float(p)) * (F.col("n") - 1) for p in shares]
    ranks = F.array_distinct(F.array(*[f(p).cast("bigint") for p in place for f in (F.floor, F.ceil)]))
    open_ = counts.where("n > 0").select(*by, F.explode(ranks).alias("rank"))
    open_ = open_.select("*", F.col("rank").alias("left"), F.lit(None).cast("bigint").alias("prefix"))
    found = None
    for level, shift in enumerate(LEVELS):
        if level:
            wanted, same = _same(keyed, open_.select(*by, "prefix").distinct(), by)
            inside = keyed.join(wanted, same & (F.shiftright("key", LEVELS[level - 1]) == F.col("prefix"))).drop(*[f"{c}_of" for c in by])
        else:
            inside = keyed.withColumn("prefix", F.lit(None).cast("bigint"))
        buckets = inside.groupBy(*by, "prefix", F.shiftright("key", shift).alias("bucket")).agg(
            F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("high")
        )
        before = Window.partitionBy(*by, "prefix").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        buckets = buckets.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
        other, same = _same(open_, buckets, [*by, "prefix"])
        hit = (F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("c"))
        moved = open_.join(other, same & hit).select(
            *by, "rank", (F.col("left") - F.col("before")).alias("left"), F.col("bucket").alias("prefix"), F.when(F.col("low") == F.col("high"), F.col("low")).alias("value")
        )
        moved = materialize(moved, "ranks")
        done = moved.where("value IS NOT NULL").select(*by, "rank", "value")
        found = done if found is None else found.unionByName(done)
        open_ = moved.where("value IS NULL").drop("value")
        if open_.isEmpty():
            break
    values = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    values, same = _same(counts, values, by)
    joined = counts.join(values, same, "left")
    at = lambda p, f: F.element_at("at", f(p).cast("bigint"))
    q = [at(p, F.floor) + F.when(at(p, F.floor) == at(p, F.ceil), 0.0).otherwise((at(p, F.ceil) - at(p, F.floor)) * (p - F.floor(p))) for p in place]
    return joined.select(*by, "n", F.when(F.col("n") > 0, F.array(*q)).alias("q"))
