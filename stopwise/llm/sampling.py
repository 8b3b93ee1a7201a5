"""Bounded samples for fitting models and centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

PLACES = 1 << 20


def smallest(frame: DataFrame, key: str, rows: int, seed: int = 0) -> list[Row]:
    """The ``rows`` rows (all, when there are fewer) with the smallest hash places of ``key``.

    Rows are first cut to the lowest hash places, about one and a half times as many as wanted, so what
    the tasks send doesn't grow with their number. Ties go by the key.
    """
    total = frame.count()
    if not total:
        return []
    part = min(PLACES, int(PLACES * (1.5 * rows + 100) / total) + 1)
    placed = frame.withColumn("_place", F.xxhash64(F.lit(seed), F.col(key)).bitwiseAND(PLACES - 1))
    return placed.where(F.col("_place") < part).orderBy("_place", key).limit(rows).drop("_place").collect()
