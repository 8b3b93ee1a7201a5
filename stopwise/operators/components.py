"""Truncated SVD of the sparse training rows of all folds at once, and the projection of every row.

Randomised range finder: a thin block V of random columns is multiplied by the fold's A'A a few times
and made orthonormal after each, which turns it towards the leading right singular vectors; the final
product gives the small matrix V'A'AV, whose eigenvectors are the components.

* Rows lie in packed blocks of about ``BLOCK_ENTRIES`` entries. A block holds rows of one fold and role, or
  (``pack_counts``) the term counts of rows of any cell, which all folds share: a task makes a fold's weights
  from them when it needs them, so the matrix is stored once and not once a fold.
* V is a table (one packed row per fold): vocabulary size x (components + ``SPARE``) numbers, bounded by two
  parameters whatever the number of rows. A product broadcasts it; blocks are read where they lie and never
  shuffled. There are at most as many tasks as slots, and each adds up A_b'(A_b V) over its blocks first, so a
  product shuffles slots x folds x V at most, however many rows there are.
* Orthonormalisation sees one V per fold. No loop is over folds but inside a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise import fixed
from stopwise.session import materialize

BLOCK_ENTRIES = 2_000_000
SPARE, ITERATIONS = 8, 5
#: Entries that are multiplied together; bounds the work arrays of a task.
STRIP = 20_000
BLOCKS = "fold string, role string, block int, rows binary, starts binary, terms binary, weights binary"
SHARED = "rows binary, starts binary, terms binary, weights binary, cells binary"
BASIS = "fold string, size int, width int, singular array<double>, basis binary"


def pack_rows(weights: DataFrame, roles: DataFrame) -> DataFrame:
    """Blocks of the rows of ``weights`` (fold, row_id, term_id, weight) by their ``roles`` (fold, row_id, role)."""
    entries = F.array_sort(F.collect_list(F.struct("term_id", "weight")))
    rows = weights.groupBy("fold", "row_id").agg(entries.alias("items"))
    rows = rows.join(roles.select("fold", "row_id", "role"), ["fold", "row_id"])
    rows = rows.select("fold", "role", "row_id", F.col("items.term_id").alias("terms"), F.col("items.weight").alias("weights"))
    rows = materialize(rows, "sparse")
    sizes = rows.groupBy("fold", "role").agg(F.ceil(F.sum(F.size("terms")) / BLOCK_ENTRIES).cast("int").alias("blocks"))
    placed = rows.join(sizes, ["fold", "role"]).withColumn("block", F.pmod(F.xxhash64("row_id"), "blocks").cast("int")).drop("blocks")

    def pack(data: pa.Table) -> pa.Table:
        terms, weights_ = (data.column(c).combine_chunks() for c in ("terms", "weights"))
        terms, weights_ = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (terms, weights_))
        starts = np.asarray(terms.offsets).astype(np.int64)
        raw = {
            "rows": np.asarray(data.column("row_id")).astype(np.int64),
            "starts": starts - starts[0],
            "terms": np.asarray(terms.flatten()).astype(np.int32),
            "weights": np.asarray(weights_.flatten()).astype(np.float64),
        }
        head = {c: data.column(c)[:1] for c in ("fold", "role", "block")}
        return pa.table(head | {c: pa.array([v.tobytes()], pa.binary()) for c, v in raw.items()})

    return materialize(placed.groupBy("fold", "role", "block").applyInArrow(pack, BLOCKS), "blocks")


class Block:
    """One packed block; ``times`` is A_b V and ``back`` is A_b' Y."""

    def __init__(self, rows: np.ndarray, starts: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        self.rows, self.starts, self.terms, self.weights = rows, starts, terms, weights

    @classmethod
    def read(cls, data: pa.RecordBatch) -> Block:
        kinds = {"rows": np.int64, "starts": np.int64, "terms": np.int32, "weights": np.float64}
        return cls(*[np.frombuffer(data.column(c)[0].as_py(), kind) for c, kind in kinds.items()])

    def _strips(self) -> Iterator[tuple[int, int]]:
        """Row ranges of about STRIP entries."""
        first = 0
        while first < len(self.rows):
            last = max(first + 1, int(np.searchsorted(self.starts, self.starts[first] + STRIP, "right")) - 1)
            yield first, last
            first = last

    def times(self, v: np.ndarray) -> np.ndarray:
        out = np.empty((len(self.rows), v.shape[1]))
        for a, b in self._strips():
            s, e = self.starts[a], self.starts[b]
            out[a:b] = np.add.reduceat(v[self.terms[s:e]] * self.weights[s:e, None], self.starts[a:b] - s)
        return out

    def back(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms that occur, and their rows of the product."""
        owner = np.repeat(np.arange(len(self.rows)), np.diff(self.starts))
        order = np.argsort(self.terms, kind="stable")
        seen, place = np.unique(self.terms, return_inverse=True)
        out = np.zeros((len(seen), y.shape[1]))
        for s in range(0, len(order), STRIP):
            at = order[s : s + STRIP]
            here = place[at]
            first = np.flatnonzero(np.append(True, here[1:] != here[:-1]))
            out[here[first]] += np.add.reduceat(y[owner[at]] * self.weights[at, None], first)
        return seen, out


def _thin(data: pa.Table) -> np.ndarray:
    size, width = data.column("size")[0].as_py(), data.column("width")[0].as_py()
    return np.frombuffer(data.column("basis")[0].as_py(), np.float64).reshape(size, width)


def _row(fold: str, v: np.ndarray, singular: list[float] | None) -> pa.Table:
    kinds = pa.schema([("fold", pa.string()), ("size", pa.int32()), ("width", pa.int32()), ("singular", pa.list_(pa.float64())), ("basis", pa.binary())])
    values = [[fold], [v.shape[0]], [v.shape[1]], [singular], [np.ascontiguousarray(v).tobytes()]]
    return pa.table([pa.array(x, f.type) for x, f in zip(values, kinds)], schema=kinds)


@dataclass
class Folds:
    """What shared blocks need to become a fold's rows; dimensions and vocabularies, bounded by parameters."""

    terms: list[str]  # of all vocabularies, in order
    places: dict[str, np.ndarray]  # per fold, the places of its terms in ``terms``: term_id is the rank
    idf: dict[str, np.ndarray]
    roles: dict[str, np.ndarray]  # per fold the role of each cell, "" for none

    @classmethod
    def collect(cls, vocab: DataFrame, cells: DataFrame) -> Folds:
        """``vocab`` has fold, term, term_id, idf; ``cells`` has fold, cell (0 ..) and role."""
        found = vocab.select("fold", "term", "term_id", "idf").toArrow()
        terms = pa.array(sorted(set(found.column("term").to_pylist()), key=str.encode), pa.string())
        place = pa.compute.index_in(found.column("term").combine_chunks(), value_set=terms).to_numpy(zero_copy_only=False)
        fold, ids, idf = np.array(found.column("fold").to_pylist(), object), found.column("term_id").to_numpy(), found.column("idf").to_numpy()
        by_fold = {f: np.flatnonzero(fold == f) for f in sorted(set(fold.tolist()))}
        by_fold = {f: at[np.argsort(ids[at])] for f, at in by_fold.items()}
        split = cells.select("fold", "cell", "role").collect()
        roles = {f: np.full(1 + max((r["cell"] for r in split), default=0), "", object) for f in by_fold}
        for r in split:
            if r["fold"] in roles:
                roles[r["fold"]][r["cell"]] = r["role"]
        return cls(terms.to_pylist(), {f: place[at] for f, at in by_fold.items()}, {f: idf[at] for f, at in by_fold.items()}, roles)

    def blocks(self, data: pa.RecordBatch) -> Iterator[tuple[str, str, Block]]:
        """The rows of a shared block in each fold and role: (1 + ln count) x idf, rows of length one."""
        whole = Block.read(data)
        cells = np.frombuffer(data.column("cells")[0].as_py(), np.int32)
        sizes = np.diff(whole.starts)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        base = 1 + np.log(whole.weights)
        for fold, places in self.places.items():
            own = np.full(len(self.terms), -1, np.int32)
            own[places] = np.arange(len(places), dtype=np.int32)
            ids, role = own[whole.terms], self.roles[fold][cells]
            for name in sorted(set(role.tolist()) - {""}):
                at = np.flatnonzero((ids >= 0) & (role == name)[owner])
                rows, first = np.unique(owner[at], return_index=True)
                if not len(rows):
                    continue
                weights = base[at] * self.idf[fold][ids[at]]
                norm = np.sqrt(np.add.reduceat(weights * weights, first))
                weights /= np.repeat(norm, np.diff(np.append(first, len(at))))
                yield fold, name, Block(whole.rows[rows], np.append(first, len(at)), ids[at], weights)


def pack_counts(rows: DataFrame, folds: Folds) -> DataFrame:
    """Shared blocks of ``rows`` (row_id, cell, items array<struct<term, cnt>>); terms outside all vocabularies end here."""
    shared = rows.sparkSession.sparkContext.broadcast(folds.terms)

    def block(parts: list[tuple]) -> pa.RecordBatch:
        rows, cells, sizes, terms, counts = (np.concatenate(x) for x in zip(*parts))
        raw = [rows, np.append(0, np.cumsum(sizes)), terms, counts, cells]
        raw = [x.astype(kind).tobytes() for x, kind in zip(raw, (np.int64, np.int64, np.int32, np.float64, np.int32))]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in raw], ["rows", "starts", "terms", "weights", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts, held = pa.array(shared.value, pa.string()), [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                items = part.column("items")
                flat = items.flatten()
                sizes = pa.compute.list_value_length(items).to_numpy(zero_copy_only=False)
                at = pa.compute.fill_null(pa.compute.index_in(flat.field("term"), value_set=known), -1).to_numpy(zero_copy_only=False)
                kept = at >= 0
                own = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kept], minlength=len(sizes))
                some = own > 0
                counts = flat.field("cnt").to_numpy(zero_copy_only=False)[kept]
                ids, cells = (part.column(c).to_numpy(zero_copy_only=False)[some] for c in ("row_id", "cell"))
                parts.append((ids, cells, own[some], at[kept], counts))
                held += len(counts)
                if held >= BLOCK_ENTRIES:
                    yield block(parts)
                    parts, held = [], 0
        if held:
            yield block(parts)

    return materialize(rows.select("row_id", "cell", "items").mapInArrow(run, SHARED), "blocks")


def _each(blocks: DataFrame, folds: Folds | None, basis: DataFrame | None = None) -> Callable:
    """For use in tasks: (fold, role, Block) of the blocks in a batch, and the fold's V."""
    context = blocks.sparkSession.sparkContext
    state = context.broadcast(folds)
    thin = context.broadcast({r["fold"]: (r["basis"], r["size"], r["width"]) for r in basis.collect()} if basis is not None else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, Block, np.ndarray | None]]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                if state.value is None:
                    found = [(one.column("fold")[0].as_py(), one.column("role")[0].as_py(), Block.read(one))]
                else:
                    found = state.value.blocks(one)
                for fold, role, block in found:
                    raw = thin.value.get(fold)
                    yield fold, role, block, np.frombuffer(raw[0], np.float64).reshape(raw[1], raw[2]) if raw else None

    return run


def _few(blocks: DataFrame) -> DataFrame:
    """As many tasks as slots at most; each adds up over its blocks."""
    return blocks.coalesce(blocks.sparkSession.sparkContext.defaultParallelism)


def _gram_times(blocks: DataFrame, basis: DataFrame, width: int, folds: Folds | None = None) -> DataFrame:
    """A'A V of the train rows: ``fold, term_id, z0 ..``."""
    names = [f"z{j}" for j in range(width)]
    each = _each(blocks, folds, basis)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for fold, role, block, v in each(batches):
            if role == "train" and v is not None:
                seen, z = block.back(block.times(v))
                if fold not in sums:
                    sums[fold] = np.zeros_like(v)
                sums[fold][seen] += z
        for fold, z in sums.items():
            seen = np.flatnonzero(z.any(1))
            columns = np.pad(z[seen], ((0, 0), (0, width - z.shape[1]))).T
            head = [pa.array([fold] * len(seen), pa.string()), pa.array(seen, pa.int32())]
            yield pa.RecordBatch.from_arrays([*head, *map(pa.array, columns)], ["fold", "term_id", *names])

    schema = "fold string, term_id int, " + ", ".join(f"{n} double" for n in names)
    return _few(blocks).mapInArrow(multiply, schema).groupBy("fold", "term_id").agg(*[F.sum(n).alias(n) for n in names])


def fold_components(blocks: DataFrame, sizes: DataFrame, k: int = fixed.COMPONENTS, iterations: int = ITERATIONS, seed: int = fixed.SEED, folds: Folds | None = None) -> DataFrame:
    """Per fold the leading right singular vectors of its train rows (see BASIS; vectors are the columns).

    ``sizes`` has the vocabulary size per fold. A fold gets min(k, size) components; a fold without train
    rows gets singular values 0.
    """
    width = k + SPARE

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fold, size in zip(*(c.to_pylist() for c in batch.columns)):
                rng = np.random.default_rng([seed, zlib.crc32(fold.encode())])
                v = np.linalg.qr(rng.standard_normal((size, min(width, size))))[0]
                yield from _row(fold, v, None).to_batches()

    def turn(last: bool) -> Callable:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            v = _thin(right)
            z = np.zeros_like(v)
            if left.num_rows:
                z[np.asarray(left.column("term_id"))] = np.stack([np.asarray(left.column(f"z{j}")) for j in range(v.shape[1])], 1)
            fold = right.column("fold_of")[0].as_py()
            if not last:
                return _row(fold, np.linalg.qr(z)[0] if z.any() else v, None)
            small = v.T @ z
            values, vectors = np.linalg.eigh((small + small.T) / 2)
            kept = min(k, len(v))
            best = np.argsort(-values, kind="stable")[:kept]
            return _row(fold, v @ vectors[:, best], np.sqrt(np.maximum(values[best], 0)).tolist())

        return run

    basis = materialize(sizes.select("fold", F.col("size").cast("int").alias("size")).mapInArrow(start, BASIS), "basis")
    for step in range(iterations + 1):
        z = _gram_times(blocks, basis, width, folds)
        turned = z.groupBy("fold").cogroup(basis.withColumnRenamed("fold", "fold_of").groupBy("fold_of")).applyInArrow(turn(step == iterations), BASIS)
        basis = materialize(turned, "basis")
    return basis


def loadings(basis: DataFrame) -> DataFrame:
    """``fold, term_id, load array<double>``: V as one row per term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = pa.Table.from_batches([batch.slice(row, 1)])
                v, fold = _thin(one), one.column("fold")[0].as_py()
                columns = [pa.array([fold] * len(v)), pa.array(range(len(v)), pa.int32()), pa.array(v.tolist(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["fold", "term_id", "load"])

    return basis.mapInArrow(run, "fold string, term_id int, load array<double>")


def project(blocks: DataFrame, basis: DataFrame, folds: Folds | None = None) -> DataFrame:
    """``fold, role, row_id, score array<double>`` of the rows of every role."""
    each = _each(blocks, folds, basis)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fold, role, block, v in each(batches):
            y = block.times(v)
            scores = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
            columns = [pa.array([name] * len(y), pa.string()) for name in (fold, role)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(block.rows), scores], ["fold", "role", "row_id", "score"])

    return blocks.mapInArrow(multiply, "fold string, role string, row_id long, score array<double>")


def orthonormality(basis: DataFrame) -> DataFrame:
    """``fold, components, error``: largest absolute entry of V'V minus the identity, from the loadings."""
    pairs = loadings(basis).select("fold", F.posexplode("load").alias("i", "x"), "load")
    products = pairs.select("fold", "i", "x", F.posexplode("load").alias("j", "y"))
    entries = products.groupBy("fold", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
    off = F.abs(F.col("v") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    return entries.groupBy("fold").agg(F.sqrt(F.count("*")).cast("int").alias("components"), F.max(off).alias("error"))


def column_moments(weights: DataFrame, roles: DataFrame) -> DataFrame:
    """``fold, rows, trace, variance`` of the train rows: trace of A'A, and the columns' total variance (divisor rows).

    Rows without a term of the vocabulary count as zero rows.
    """
    train = roles.where(F.col("role") == "train").select("fold", "row_id")
    terms = weights.join(train, ["fold", "row_id"], "left_semi").groupBy("fold", "term_id").agg(
        F.sum("weight").alias("total"), F.sum(F.col("weight") * F.col("weight")).alias("squares")
    )
    return _moments(terms, train.groupBy("fold").agg(F.count("*").alias("rows")))


def block_moments(blocks: DataFrame, folds: Folds, rows: DataFrame) -> DataFrame:
    """``column_moments`` from shared blocks; ``rows`` has the number of train rows per fold."""
    each = _each(blocks, folds)
    size = {fold: len(places) for fold, places in folds.places.items()}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {fold: np.zeros((2, n)) for fold, n in size.items()}
        for fold, role, block, _ in each(batches):
            if role == "train":
                for own, w in zip(sums[fold], (block.weights, block.weights**2)):
                    own += np.bincount(block.terms, w, minlength=len(own))
        for fold, (total, squares) in sums.items():
            seen = np.flatnonzero(squares)
            columns = [pa.array([fold] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(total[seen]), pa.array(squares[seen])]
            yield pa.RecordBatch.from_arrays(columns, ["fold", "term_id", "total", "squares"])

    parts = _few(blocks).mapInArrow(add, "fold string, term_id int, total double, squares double")
    return _moments(parts.groupBy("fold", "term_id").agg(F.sum("total").alias("total"), F.sum("squares").alias("squares")), rows)


def _moments(terms: DataFrame, n: DataFrame) -> DataFrame:
    sums = terms.groupBy("fold").agg(F.sum("squares").alias("trace"), F.sum(F.col("total") * F.col("total")).alias("square_sums"))
    return n.join(sums, "fold").select("fold", "rows", "trace", (F.col("trace") / F.col("rows") - F.col("square_sums") / (F.col("rows") * F.col("rows"))).alias("variance"))


def explained(scores: DataFrame, moments: DataFrame) -> DataFrame:
    """``fold, component, explained``: variance of the train scores over the columns' total variance."""
    parts = scores.where(F.col("role") == "train").select("fold", F.posexplode("score").alias("component", "s"))
    sums = parts.groupBy("fold", "component").agg(F.sum("s").alias("s1"), F.sum(F.col("s") * F.col("s")).alias("s2"))
    joined = sums.join(moments, "fold")
    variance = F.col("s2") / F.col("rows") - F.pow(F.col("s1") / F.col("rows"), 2)
    return joined.select("fold", "component", F.try_divide(variance, F.col("variance")).alias("explained"))
