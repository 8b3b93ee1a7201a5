"""Embedding whitening by block Jacobi-Davidson on a covariance that is never formed.

The leading eigenvectors of the covariance V are found with nothing but products V B of thin blocks B.
A product is one distributed pass: each task centres its rows, adds up C' (C B), and Spark sums the d
rows of all tasks. The driver holds d x block matrices only.

1. A search space U with W = V U gives Ritz pairs (Rayleigh-Ritz on U'W).
2. Wanted pairs whose residual is at double precision (``TOLERANCE`` times the largest eigenvalue) are
   locked and taken out of the search space.
3. For the other wanted pairs the correction equation (I - QQ')(V - e)(I - QQ') t = -r is solved by an
   inner MINRES, Q being the locked and the current Ritz vectors; all pairs share the pass of a step.
4. The corrections are made orthogonal to everything held and widen U, which restarts from its best Ritz
   vectors when it gets too wide. In few dimensions U soon spans the space, and step 1 is then exact.

Integers keep the statistics exact: a vector c becomes x = floor(64 c) + 1000000, sums S of x are whole
numbers, and a centred entry is the whole number n x - S divided by n.

Defined results: rows whose vector is null or empty, or holds a null, a non-finite entry or one beyond a
long are dropped, as are vectors of another length than the most frequent one (the smaller on a tie).
Repeated rows count as often as they occur and each give rows of the result; a row without an id is
fitted like others and keeps its null id. Components beyond the rank (variance below ``TOLERANCE`` of
the largest) have null ``whitened`` and are no part of ``identity_error``; a table of equal vectors has
such components only, and null ``explained``. Extra columns are ignored. An empty table gives an empty
result. Equal eigenvalues leave their vectors free to turn; any orthogonal choice may come out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.llm.worker import released
from stopwise.session import materialize

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Ritz pairs beyond the wanted ones that the first search space holds.
SPARE = 8
#: Residual norm, as a share of the largest eigenvalue, at which a pair is done.
TOLERANCE = 1e-13
#: MINRES steps of a correction, and the share of the residual that ends it earlier.
INNER_STEPS, INNER_SHARE = 4, 1e-3
OUTER_STEPS = 200
Product = Callable[[np.ndarray], np.ndarray]


def orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to ``against``; columns that add nothing vanish."""
    held = np.hstack([a for a in against if a.shape[1]]) if any(a.shape[1] for a in against) else np.empty((len(block), 0))
    out = np.empty((len(block), 0))
    for column in block.T:
        size = np.linalg.norm(column)
        if not size:
            continue
        v = column / size
        basis = np.hstack((held, out))
        for _ in range(3):
            v = v - basis @ (basis.T @ v)
            rest = np.linalg.norm(v)
            if rest < 1e-10:
                break
            v /= rest
        if rest >= 1e-10:
            out = np.hstack((out, v[:, None]))
    return out


def minres(product: Product, shifts: np.ndarray, q: np.ndarray, right: np.ndarray, steps: int = INNER_STEPS) -> np.ndarray:
    """Approximate solutions t of (I - qq')(V - shift)(I - qq') t = right, one a column, by Lanczos and rotations.

    All columns take their Lanczos step from one product; a column that has ended stands still.
    """

    def project(block: np.ndarray) -> np.ndarray:
        return block - q @ (q.T @ block)

    v = project(right)
    beta = np.linalg.norm(v, axis=0)
    start = beta.copy()
    live = beta > 0
    solution, before = np.zeros_like(v), np.zeros_like(v)
    v = np.divide(v, beta, out=np.zeros_like(v), where=live)
    # last two search directions and rotations (c, s), and what is left of the residual
    d1, d2 = np.zeros_like(v), np.zeros_like(v)
    one, zero = np.ones(len(beta)), np.zeros(len(beta))
    c1, s1, c2, s2 = one.copy(), zero.copy(), one.copy(), zero.copy()
    rest, coupling = beta.copy(), zero.copy()
    for _ in range(steps):
        if not live.any():
            break
        w = project(product(v)) - shifts * v - coupling * before
        alpha = (v * w).sum(0)
        w = project(w - alpha * v)
        following = np.linalg.norm(w, axis=0)
        # the new column of the tridiagonal matrix under the last two rotations
        far, near = s2 * coupling, c2 * coupling
        upper, diagonal = c1 * near + s1 * alpha, c1 * alpha - s1 * near
        size = np.hypot(diagonal, following)
        ok = live & (size > 0)
        safe = np.where(ok, size, 1.0)
        c, s = diagonal / safe, following / safe
        direction = (v - far * d2 - upper * d1) / safe
        solution = np.where(ok, solution + c * rest * direction, solution)
        rest = np.where(ok, -s * rest, rest)
        d2, d1 = d1, direction
        c2, s2, c1, s1 = c1, s1, c, s
        live = ok & (following > 1e-14 * np.abs(shifts).max()) & (np.abs(rest) > INNER_SHARE * start)
        before, coupling = v, following
        v = np.divide(w, following, out=np.zeros_like(w), where=live)
    return project(solution)


def jacobi_davidson(product: Product, dim: int, wanted: int, seed: int = 11, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues (falling) and their unit eigenvectors of the symmetric matrix behind ``product``."""
    rng = np.random.default_rng(seed)
    limit = min(dim, limit or 4 * (wanted + SPARE))
    u = orthonormal(rng.standard_normal((dim, min(dim, wanted + SPARE))))
    w = product(u)
    values, vectors = np.empty(0), np.empty((dim, 0))
    for _ in range(OUTER_STEPS):
        small = u.T @ w
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        u, w = u @ turn, w @ turn
        left = min(wanted - len(values), len(theta))
        residual = w[:, :left] - u[:, :left] * theta[:left]
        largest = max([*values, *theta[:1], 0.0])
        done = np.linalg.norm(residual, axis=0) <= TOLERANCE * largest
        whole = u.shape[1] + len(values) == dim
        if whole:  # nothing is left to add, the pairs are exact but for rounding
            done[:] = True
        at = np.flatnonzero(done)
        values, vectors = np.append(values, theta[at]), np.hstack((vectors, u[:, at]))
        if len(values) >= wanted or whole:
            order = np.argsort(-values, kind="stable")
            return values[order], vectors[:, order]
        open_ = np.flatnonzero(~done)
        shifts, residual = theta[open_], residual[:, open_]
        ritz = u[:, open_]
        kept = np.setdiff1d(np.arange(len(theta)), at)
        u, w = u[:, kept], w[:, kept]
        step = minres(product, shifts, np.hstack((vectors, ritz)), -residual)
        if u.shape[1] + len(open_) > limit:
            few = max(wanted - len(values) + SPARE, 1)
            u, w = u[:, :few], w[:, :few]
        # rounding errors of a long search must not let locked vectors back in
        u_new = orthonormal(step, vectors, u)
        if not u_new.shape[1]:
            u_new = orthonormal(rng.standard_normal((dim, SPARE)), vectors, u)
        u, w = np.hstack((u, u_new)), np.hstack((w, product(u_new)))
        if len(at):  # deflate
            overlap = vectors.T @ u
            u, w = u - vectors @ overlap, w - vectors @ (values[:, None] * overlap)
    raise RuntimeError(f"{wanted - len(values)} of {wanted} eigenpairs did not reach double precision")


@dataclass
class Fit:
    """Whole numbers x per row (``rows``: vec_id, x), their count, sums and leading components."""

    rows: DataFrame
    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x array<bigint>`` of the usable rows."""
    v = F.col(vector_col).cast("array<double>")
    most = float(2**62 // SCALE)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < most))
    kept = vectors.where(v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sum_rows(rows: DataFrame, run: Callable, dim: int, names: list[str], kind: str) -> np.ndarray:
    """Tables of ``dim`` rows from every task, added up by Spark; the driver gets ``dim`` rows."""
    schema = "i int, " + ", ".join(f"{name} {kind}" for name in names)
    total = rows.mapInArrow(released(run), schema).groupBy("i").agg(*[F.sum(name).alias(name) for name in names]).collect()
    out = np.zeros((dim, len(names)), np.int64 if kind == "long" else np.float64)
    for row in total:
        out[row["i"]] = [row[name] for name in names]
    return out


def _block(table: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(table)), pa.int32()), *[pa.array(c) for c in table.T]], ["i", *names])


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Centred entries: exact whole numbers, one division."""
    return (n * x - sums) / float(n)


def exact_sums(rows: DataFrame, dim: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, 1), np.int64)
        for batch in batches:
            total[:, 0] += matrix(batch, dim).sum(0)
        yield _block(total, ["s"])

    return _sum_rows(rows, run, dim, ["s"], "long")[:, 0]


def covariance_product(rows: DataFrame, n: int, sums: np.ndarray, block: np.ndarray, squares: bool = False) -> np.ndarray:
    """V times ``block`` in one pass; with ``squares``, V's diagonal as one more column."""
    dim, names = len(sums), [f"c{j}" for j in range(block.shape[1] + squares)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, len(names)))
        for batch in batches:
            c = centred(matrix(batch, dim), n, sums)
            total[:, : block.shape[1]] += c.T @ (c @ block)
            if squares:
                total[:, -1] += np.square(c).sum(0)
        yield _block(total, names)

    return _sum_rows(rows, run, dim, names, "double") / n


def fit(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> Fit | None:
    """Statistics and leading components of all usable rows; None when there are none."""
    prepared = whole_numbers(vectors, id_col, vector_col)
    stored = materialize(prepared.withColumn("dim", F.size("x")), "whole")
    common = stored.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not common:
        return None
    dim, n = common[0]["dim"], common[0]["count"]
    rows = stored.where(F.col("dim") == dim).select("vec_id", "x")
    sums = exact_sums(rows, dim)
    spread: list[float] = []

    def product(block: np.ndarray) -> np.ndarray:
        if spread:
            return covariance_product(rows, n, sums, block)
        found = covariance_product(rows, n, sums, block, squares=True)
        spread.append(float(found[:, -1].sum()))
        return found[:, :-1]

    values, units = jacobi_davidson(product, dim, min(components, dim))
    return Fit(rows, n, sums, spread[0], np.maximum(values, 0.0), units)


def projection(found: Fit) -> np.ndarray:
    """Columns that turn centred rows into whitened ones; NaN for components without variance."""
    scale = np.where(found.values > TOLERANCE * max(found.values[0], 0.0), found.values, np.nan)
    return found.vectors / np.sqrt(scale)


def identity_error(found: Fit) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity, from the rows themselves."""
    turn = projection(found)
    turn = turn[:, ~np.isnan(turn).any(0)]
    dim, n, sums, k = len(found.sums), found.n, found.sums, turn.shape[1]
    if not k:
        return None

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, 1))
        for batch in batches:
            total[:, 0] += (centred(matrix(batch, dim), n, sums) @ turn).sum(0)
        yield _block(total, ["m"])

    mean = _sum_rows(found.rows, means, k, ["m"], "double")[:, 0] / n
    names = [f"c{j}" for j in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            w = centred(matrix(batch, dim), n, sums) @ turn - mean
            total += w.T @ w
        yield _block(total, names)

    return float(np.abs(_sum_rows(found.rows, run, k, names, "double") / n - np.eye(k)).max())


SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component (see SCHEMA); ``deviation`` is the sum over dimensions of (n x - S)^2."""
    found = fit(vectors, components, id_col, vector_col)
    if found is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    n, sums, dim, turn = found.n, found.sums, len(found.sums), projection(found)
    k, error = turn.shape[1], identity_error(found)
    explained = [float(e) / found.trace if found.trace > 0 else None for e in found.values]
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0))])
    for name in ("whitened", "explained", "identity_error"):
        schema = schema.append(pa.field(name, pa.float64()))

    def deviations(off: np.ndarray) -> pa.Array:
        """Exact: in 64 bits where they suffice, else in Python's whole numbers."""
        if dim * float(np.abs(off).max(initial=0)) ** 2 < 2**62:
            return pa.array((off * off).sum(1), pa.int64()).cast(pa.decimal128(38, 0))
        return pa.array([sum(v * v for v in row) for row in off.tolist()], pa.decimal128(38, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off = n * matrix(batch, dim) - sums
            each = pa.array(np.repeat(np.arange(len(off)), k))
            flat = ((off / float(n)) @ turn).ravel()
            columns = [
                batch.column(0).take(each),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(off))),
                pa.array(np.full(len(each), n)),
                deviations(off).take(each),
                pa.array(flat, mask=np.isnan(flat)),
                pa.array(explained * len(off), pa.float64()),
                pa.array([error] * len(each), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return found.rows.mapInArrow(released(run), SCHEMA)
