"""Ranking helpers that keep their result exact under skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopwise.session import materialize


def range_ids(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Number the rows of each group 0 .. n-1 in ``order``, whatever the alphabet or the size of a group.

    Rows are dealt out by sampled ranges of (by, order), so a large group is many ranges. A row's place
    inside its range is written with it; a range's offset in its group follows from the measured sizes of
    the ranges before it. ``name`` holds the number, ``<name>_total`` the group's size. Groups are not NULL.
    """
    by = list(by)
    placed = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed, "ranged").withColumn("_range", F.shiftright("_at", 33))
    sizes = placed.groupBy(*by, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *by,
        "_range",
        (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_size").over(Window.partitionBy(*by)).alias(f"{name}_total"),
    )
    return placed.join(offsets, [*by, "_range"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def top_by(df: DataFrame, by: Sequence[str], score: str, key: str, k: int) -> DataFrame:
    """The k rows per group with the largest whole-number ``score``, ties by ascending ``key``.

    A histogram of the scores gives the score of the k-th row; only rows with just that score are
    ordered, by ranges.
    """
    by = list(by)
    df = materialize(df, "scored")
    histogram = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("_c"))
    above = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    counted = histogram.withColumn("_above", F.coalesce(F.sum("_c").over(above), F.lit(0))).where(F.col("_above") < k)
    edge = counted.groupBy(*by).agg(F.min(score).alias("_edge"), (F.lit(k) - F.max("_above")).alias("_room"))
    placed = df.join(edge, by) if by else df.crossJoin(edge)
    ties = range_ids(placed.where(F.col(score) == F.col("_edge")), by, [key], "_tie").where(F.col("_tie") < F.col("_room"))
    return placed.where(F.col(score) > F.col("_edge")).select(*df.columns).unionByName(ties.select(*df.columns))


def ordered_ids(df: DataFrame, by: Sequence[str], key: str, bucket: Column, name: str) -> DataFrame:
    """Number distinct keys 0 .. n-1 per group in (bucket, key) order, without sorting a group in one task.

    Every bucket numbers its own keys and starts after the buckets before it; only bucket sizes,
    one row per bucket, are cumulated per group. ``name`` holds the number, ``<name>_total`` the
    group's size.
    """
    by = list(by)
    named = df.withColumn("_bucket", bucket)
    sizes = named.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *by,
        "_bucket",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
        F.sum("_size").over(Window.partitionBy(*by)).alias(f"{name}_total"),
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(key)
    return (
        named.withColumn("_rn", F.row_number().over(inside) - 1)
        .join(offsets, by + ["_bucket"])
        .withColumn(name, F.col("_offset") + F.col("_rn"))
        .drop("_bucket", "_size", "_offset", "_rn")
    )
