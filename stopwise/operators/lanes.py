"""Bootstrap replicates as lanes of vectors.

Per fold, the draw counts of all tasks and replicates are one packed matrix (tasks x replicates, a
size that no number of rows changes). Decisions come in chunks of a fold; a chunk meets the matrix
once, and what leaves it are vectors of sums with one lane per replicate. Neither a replicate nor a
score is ever part of a shuffle key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise import fixed

#: Decision cells of a fold that one task takes, and vectors that one task adds up.
CHUNK, FAN = 50_000, 256
#: Numbers of a work array (scores x replicates).
STRIP = 4_000_000


def _fields(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def _head(data: pa.Table, names: Sequence[str]) -> dict:
    """The key columns of a group, as one row under the names of ``names``."""
    return {n: data.column(c)[:1] for c, n in (names.items() if isinstance(names, dict) else zip(names, names))}


def _raw(vector: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(vector).tobytes()], pa.binary())


def _beside(left: DataFrame, right: DataFrame, keys: Sequence[str], run: Callable, schema: str) -> DataFrame:
    """``run`` on the groups of two tables that may share their origin."""
    other = [f"{k}_of" for k in keys]
    right = right.withColumnsRenamed(dict(zip(keys, other)))
    return left.groupBy(*keys).cogroup(right.groupBy(*other)).applyInArrow(run, schema)


def draw(ids: DataFrame, fold: Sequence[str], replicates: int, seed: Column | int) -> DataFrame:
    """``fold, tasks, counts``: how often each task is drawn in each replicate (int32, tasks x replicates).

    ``ids`` number the tasks of a fold 0 .. n-1. Draw i of a replicate is a hash of (seed, fold, replicate, i).
    """
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    text = F.concat_ws("|", seed.cast("string"), *[F.col(c).cast("string") for c in fold])

    def run(data: pa.Table) -> pa.Table:
        data = data.sort_by("id")
        n = data.num_rows
        prefix = data.column("prefix")[0].as_py() + "|"
        counts = np.zeros((n, replicates), np.int32)
        numbers = [str(i) for i in range(n)]
        for rep in range(replicates):
            start = hashlib.md5(f"{prefix}{rep}|".encode())
            drawn = np.empty(n, np.uint32)
            for i, number in enumerate(numbers):
                own = start.copy()
                own.update(number.encode())
                drawn[i] = int.from_bytes(own.digest()[:4], "big")
            counts[:, rep] = np.bincount(drawn % np.uint32(n), minlength=n)
        tasks = pa.array([data.column("instance_id").to_pylist()], pa.list_(pa.string()))
        return pa.table(_head(data, fold) | {"tasks": tasks, "counts": _raw(counts)})

    return ids.withColumn("prefix", text).groupBy(*fold).applyInArrow(run, f"{_fields(ids, fold)}, tasks array<string>, counts binary")


PLAN = "tasks array<string>, counts binary, log_r binary, usable binary, degenerate binary"


def _plan(data: pa.Table, fold: Sequence[str], log_r: np.ndarray, usable: np.ndarray, degenerate: np.ndarray) -> pa.Table:
    own = {c: data.column(c)[:1] for c in ("tasks", "counts")}
    return pa.table(_head(data, {f"{c}_of": c for c in fold}) | own | {"log_r": _raw(log_r), "usable": _raw(usable), "degenerate": _raw(degenerate)})


def fixed_coefficient(drawn: DataFrame, coefficients: DataFrame, fold: Sequence[str], replicates: int) -> DataFrame:
    """``drawn`` with the fold's ``log_r`` in every lane (see PLAN)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _plan(right, fold, *[np.empty(0)] * 3).slice(0, 0)
        value = left.column("log_r")[0].as_py()
        log_r = np.full(replicates, np.nan if value is None else value)
        return _plan(right, fold, log_r, np.full(replicates, value is not None), np.zeros(replicates, bool))

    return _beside(coefficients, drawn, fold, run, f"{_fields(drawn, fold)}, {PLAN}")


def log_odds(p: np.ndarray) -> np.ndarray:
    inner = np.clip(p, 1e-300, 1 - 1e-16)
    return np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, np.log(inner / (1 - inner))))


def drawn_coefficient(drawn: DataFrame, sides: DataFrame, fold: Sequence[str], replicates: int) -> DataFrame:
    """``drawn`` with the log ratio of both priors recomputed in every lane; lanes without rows on a side are unusable."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _plan(right, fold, *[np.empty(0)] * 3).slice(0, 0)
        counts, at = _counts(right, left, replicates)
        inside = np.flatnonzero(at >= 0)
        total = {}
        for name in ("target_n", "target_r", "train_n", "train_r"):
            values = np.asarray(pc.fill_null(left.column(name).combine_chunks().cast(pa.float64()), 0.0))[inside]
            total[name] = values @ counts[at[inside]]
        usable = (total["target_n"] > 0) & (total["train_n"] > 0)
        with np.errstate(invalid="ignore", divide="ignore"):
            target, train = total["target_r"] / total["target_n"], total["train_r"] / total["train_n"]
            log_r = log_odds(target) - log_odds(train)
            degenerate = ~((target > 0) & (target < 1) & (train > 0) & (train < 1))
        return _plan(right, fold, log_r, usable, degenerate)

    return _beside(sides, drawn, fold, run, f"{_fields(drawn, fold)}, {PLAN}")


def _counts(plan: pa.Table, rows: pa.Table, replicates: int) -> tuple[np.ndarray, np.ndarray]:
    """The matrix of draw counts, and the place of each row's task in it (-1 for others)."""
    tasks = plan.column("tasks")[0].values
    counts = np.frombuffer(plan.column("counts")[0].as_py(), np.int32).reshape(-1, replicates)
    at = pc.fill_null(pc.index_in(rows.column("instance_id").combine_chunks(), value_set=tasks), -1)
    return counts, np.asarray(at)


SUMS = "n binary, k binary, sr binary, usable binary, degenerate binary"


def corrected_sums(cells: DataFrame, plan: DataFrame, fold: Sequence[str], replicates: int) -> DataFrame:
    """Per fold and lane: decisions, correct ones and the sum of corrected scores (see SUMS)."""
    chunks = F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")
    sizes = cells.groupBy(*fold).agg(chunks)
    placed = cells.join(sizes, list(fold)).withColumn("chunk", F.pmod(F.xxhash64("instance_id", "decision_score"), "chunks").cast("int")).drop("chunks")
    copies = plan.join(sizes, list(fold)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    keys = [*fold, "chunk"]
    names = [part.split()[0] for part in SUMS.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table(_head(left, keys) | {n: _raw(np.empty(0)) for n in names}).slice(0, 0)
        counts, at = _counts(right, left, replicates)
        inside = np.flatnonzero(at >= 0)
        at = at[inside]
        n, k = (np.asarray(left.column(c).combine_chunks().cast(pa.float64()))[inside] for c in ("n", "k"))
        score = np.asarray(left.column("decision_score").combine_chunks())[inside]
        sign = np.where(np.asarray(pc.equal(left.column("head"), "success").combine_chunks().fill_null(False))[inside], 1.0, -1.0)
        log_r = np.frombuffer(right.column("log_r")[0].as_py(), np.float64)
        clipped = np.clip(score, fixed.LOGIT_EPS, 1 - fixed.LOGIT_EPS)
        logit = np.log(clipped / (1 - clipped))
        # one row of lanes for each distinct score and head
        both, place = np.unique(np.stack([logit, sign], 1), axis=0, return_inverse=True)
        order = np.argsort(place.ravel(), kind="stable")
        place = place.ravel()[order]
        sr = np.zeros(replicates)
        width = max(1, STRIP // replicates)
        bounds = np.searchsorted(place, np.arange(0, len(both) + width, width))
        for i, (first, last) in enumerate(zip(bounds, bounds[1:])):
            rows = order[first:last]
            if not len(rows):
                continue
            own = both[i * width : (i + 1) * width]
            weight = np.zeros((len(own), replicates))
            for s in range(0, len(rows), width):
                np.add.at(weight, place[first + s : first + min(s + width, len(rows))] - i * width, n[rows[s : s + width], None] * counts[at[rows[s : s + width]]])
            with np.errstate(over="ignore", invalid="ignore"):
                z = own[:, :1] + own[:, 1:] * log_r
                tail = np.exp(-np.abs(z))
                p = np.where(z >= 0, 1 / (1 + tail), tail / (1 + tail))
                p[np.isnan(z)] = np.nan
            sr += np.where(weight > 0, weight * p, 0.0).sum(0)
        total = np.bincount(at, n, len(counts)) @ counts, np.bincount(at, k, len(counts)) @ counts
        out = {"n": _raw(total[0]), "k": _raw(total[1]), "sr": _raw(sr)}
        return pa.table(_head(left, keys) | out | {c: right.column(c)[:1] for c in ("usable", "degenerate")})

    schema = f"{_fields(placed, keys)}, {SUMS}"
    parts = _beside(placed, copies, keys, run, schema)
    # a tree of two levels, so that a fold with very many chunks is no single group
    tier = parts.withColumn("chunk", F.floor(F.col("chunk") / FAN).cast("int"))
    return _added(_added(tier, keys), fold)


def _added(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    def run(data: pa.Table) -> pa.Table:
        out = {c: _raw(np.sum([np.frombuffer(v.as_py()) for v in data.column(c)], axis=0)) for c in ("n", "k", "sr")}
        return pa.table(_head(data, keys) | out | {c: data.column(c)[:1] for c in ("usable", "degenerate")})

    return parts.groupBy(*keys).applyInArrow(run, f"{_fields(parts, keys)}, {SUMS}")


def medians(sums: DataFrame, scope: Sequence[str], fold: Sequence[str], replicates: int, min_decisions: int) -> DataFrame:
    """``scope, rep, median_gap, median_abs_gap, degenerate``: medians over the folds of a target, lane by lane.

    A fold counts in the lanes where it has a coefficient and enough decisions; a lane without folds has no row.
    """

    def middle(values: np.ndarray, present: np.ndarray) -> np.ndarray:
        """Median of the present values of each lane; NaN is the largest value."""
        ordered = np.sort(np.where(present, values, np.nan), axis=0)
        m = present.sum(0)
        lane = np.arange(values.shape[1])
        low, high = ordered[np.maximum((m - 1) // 2, 0), lane], ordered[np.minimum(m // 2, len(values) - 1), lane]
        return low + (high - low) * 0.5

    def run(data: pa.Table) -> pa.Table:
        vector = lambda c, kind: np.stack([np.frombuffer(v.as_py(), kind) for v in data.column(c)])
        n, k, sr = (vector(c, np.float64) for c in ("n", "k", "sr"))
        present = vector("usable", bool) & (n >= min_decisions) & (n > 0)
        with np.errstate(invalid="ignore", divide="ignore"):
            gap = sr / n - k / n
        rep = np.flatnonzero(present.any(0))
        flags = (vector("degenerate", bool) & present).any(0)
        keys = {c: data.column(c).combine_chunks().take(pa.array(np.zeros(len(rep), np.int64))) for c in scope}
        values = (middle(gap, present), middle(np.abs(gap), present))
        return pa.table(keys | {"rep": pa.array(rep, pa.int64()), "median_gap": pa.array(values[0][rep]), "median_abs_gap": pa.array(values[1][rep]), "degenerate": pa.array(flags[rep])})

    return sums.groupBy(*scope).applyInArrow(run, f"{_fields(sums, scope)}, rep long, median_gap double, median_abs_gap double, degenerate boolean")
