"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one kept vector per group.

1. Equal vectors form a class; one of them, with the class's size, takes part.
2. Spherical k-means gives the cells. Centroids are fitted on a bounded sample (``SAMPLE`` vectors, the
   smallest by a hash of the id); every vector is assigned, to the nearest centroid.
3. Exactness across cells: let x and y link, so |x - y| <= d with d = sqrt(2 - 2 t), and let c, e be
   their centroids. Their distances from the hyperplane between c and e add up to d at most. So a vector of
   a cell is compared with one of another cell unless its distance and the other block's least distance add up to more.
   No linked pair is lost.
4. Cells are cut into blocks of about ``BLOCK`` vectors by a hash, and a vector lies in one block only. Neighbouring
   blocks make tiles. A task multiplies the blocks of two tiles and returns per vector a sum of links, and a
   spanning forest of the links it saw; pairs are never listed.
5. Tiles meet in waves. A wave sends twice as many tiles as there are and its shuffle ends with it, so disk grows with the
   vectors, and not with the pairs of tiles, whatever their number.
6. Components come from the forests by distributed connected components.

Defined results: a vector that is null, empty, all zero, or holds a null or a non-finite component has
no links and is its own component. Vectors of different length don't link. Rows are vectors of their own,
also where an id repeats, with the same vector or another: each gives one row of the result. A row without
an id counts and links like others; its component is the smallest id it reaches, null if there is none, and
it is never kept. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.llm.graph import components, forest
from stopwise.llm.sampling import smallest
from stopwise.session import discard, local_frame, materialize, materialize_all

SAMPLE = 20_000
CELL, MAX_CELLS = 4096, 1024
BLOCK = 2048
#: A tile has so many vectors at most (and one block at least), or this share of all vectors, if that is less.
TILE, TILES = 32_768, 8
#: A wave sends so many bytes of vectors at least.
WAVE_BYTES = 64_000_000
ROUNDS = 8


def usable(rows: list) -> list[int]:
    """Positions of the vectors that can link."""
    return [i for i, row in enumerate(rows) if row and None not in row and np.isfinite(row).all() and np.any(row)]


def unpack_block(raw: bytes, n: int, dim: int) -> np.ndarray:
    step = len(raw) // n
    return unpack([raw[i : i + step] for i in range(0, len(raw), step)], dim)


def fit_cells(sample: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Unit centroids of spherical k-means; an empty cell takes the vector that fits worst."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), k, replace=False)].copy()
    for _ in range(rounds):
        near = sample @ centroids.T
        own = near.argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        worst = np.argsort(near.max(1), kind="stable")
        for n, cell in enumerate(np.flatnonzero(np.bincount(own, minlength=k) == 0)):
            sums[cell] = sample[worst[n]]
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 0, sums / np.maximum(size, 1e-300), centroids)
    return centroids


class Cells:
    def __init__(self, centroids: np.ndarray, threshold: float):
        self.centroids = centroids
        # a little more than the distances, as the difference of near centroids is rounded; more only makes more guests
        self.gap = np.sqrt(np.maximum(2 - 2 * (centroids @ centroids.T), 0)) + 1e-7
        self.most = np.sqrt(2 - 2 * threshold) + 1e-8

    def home(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centroids.T).argmax(1)

    def distances(self, x: np.ndarray, cell: int, others: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Distances of vectors of ``cell`` from the hyperplanes between it and other cells; 0 for its own."""
        s = x @ self.centroids[others].T
        return ((x @ self.centroids[cell])[:, None] - s) / self.gap[cell, others]


def tiles_of(sizes: np.ndarray, dims: np.ndarray) -> np.ndarray:
    """Tile of each block, by the blocks' numbers of vectors; blocks of a tile are neighbours and have one length."""
    most = max(min(TILE, -(-int(sizes.sum()) // TILES)), BLOCK)
    tile, held, out = -1, most, []
    for i, size in enumerate(sizes.tolist()):
        if held + size > most or dims[i] != dims[i - 1]:
            tile, held = tile + 1, 0
        held += size
        out.append(tile)
    return np.array(out, np.int64)


def waves(pairs: list[tuple[int, int]], tiles: int, tile_bytes: float) -> Iterator[list[tuple[int, int]]]:
    """Tile pairs dealt out so that a wave sends each tile about twice, or WAVE_BYTES."""
    pairs = sorted(pairs, key=lambda p: (p[1] - p[0], p[0]))
    step = max(tiles, int(WAVE_BYTES / (2 * max(tile_bytes, 1))))
    for first in range(0, len(pairs), step):
        yield pairs[first : first + step]


def payload(v: list) -> bytes:
    """A vector's bytes: four a component when that loses nothing, else eight."""
    wide = np.asarray(v, np.float64)
    narrow = wide.astype(np.float32)
    return narrow.tobytes() if (narrow == wide).all() else wide.tobytes()


def unpack(vectors: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    out = np.empty((len(vectors), dim))
    for i, raw in enumerate(vectors):
        out[i] = np.frombuffer(raw, np.float32 if len(raw) == 4 * dim else np.float64)
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def near_dedup(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    spark = vectors.sparkSession

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            raw, dims = [None] * len(rows), [None] * len(rows)
            for i in usable(rows):
                raw[i], dims[i] = payload(rows[i]), len(rows[i])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], ["id", "dim", "unit"])

    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    cleaned = named.mapInArrow(clean, "id long, dim int, unit binary").withColumn("key", F.unhex(F.sha1("unit")))
    rows = materialize(cleaned.select("id", "key"), "rows")
    valid = rows.where("key IS NOT NULL")
    # a class has a number of its own, since an id may repeat or be missing; its rows have the same vector
    same = cleaned.where("key IS NOT NULL").groupBy("key")
    same = same.agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("unit").alias("unit"))
    whole = materialize(same.withColumn("rep", F.monotonically_increasing_id()), "classes")
    classes = materialize(whole.select("key", "rep", "least", "copies"), "numbers")
    reps = whole.select("rep", "copies", "dim", "unit")
    # cells for the most frequent length; vectors of another length share one cell per length
    common = reps.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim, n = (common[0]["dim"], common[0]["count"]) if common else (1, 0)
    drawn = smallest(reps.where(F.col("dim") == dim).select("rep", "unit"), "rep", SAMPLE) if n else []
    sample = unpack([r["unit"] for r in drawn], dim)
    k = max(1, min(n // CELL, MAX_CELLS, len(sample)))
    cells = Cells(fit_cells(sample, k) if len(sample) else np.zeros((1, dim)), threshold)
    shared = spark.sparkContext.broadcast(cells)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(2))
            home = np.zeros(len(dims), np.int32)
            at = np.flatnonzero(dims == dim)
            if len(at):
                home[at] = shared.value.home(unpack(batch.column(3).take(pa.array(at)).to_pylist(), dim))
            yield pa.RecordBatch.from_arrays([pa.array(home), *batch.columns], ["cell", *batch.schema.names])

    placed = reps.mapInArrow(assign, "cell int, rep long, copies long, dim int, unit binary")
    # one row for each cell
    sizes = materialize(placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    blocked = placed.join(sizes, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))

    def pack(data: pa.Table) -> pa.Table:
        one = {c: data.column(c)[:1] for c in ("dim", "cell", "block")}
        packed = {c: np.asarray(data.column(c)).astype(np.int64).tobytes() for c in ("rep", "copies")}
        vectors, own, cell = data.column("unit").to_pylist(), data["dim"][0].as_py(), data["cell"][0].as_py()
        if len({len(v) for v in vectors}) > 1:  # mixed widths: all as doubles
            vectors = [np.frombuffer(v, np.float32).astype(np.float64).tobytes() if len(v) == 4 * own else v for v in vectors]
        packed["unit"] = b"".join(vectors)
        least = shared.value.distances(unpack(vectors, own), cell).min(0) if own == dim else np.empty(0)
        packed["least"] = least.tobytes()
        return pa.table(one | {c: pa.array([v], pa.binary()) for c, v in packed.items()})

    schema = "dim int, cell int, block int, rep binary, copies binary, unit binary, least binary"
    blocks = materialize(blocked.groupBy("dim", "cell", "block").applyInArrow(pack, schema), "blocks")
    discard(whole)
    # what the driver sees of a block: its size, and its least distance from each cell
    known = blocks.select("dim", "cell", "block", (F.length("rep") / 8).cast("long").alias("n"), F.length("unit").alias("bytes"), "least")
    known = sorted(known.collect(), key=lambda r: (r["dim"], r["cell"], r["block"]))
    tile = tiles_of(np.array([r["n"] for r in known], np.int64), np.array([r["dim"] for r in known]))
    members: dict[int, list] = {}
    for r, t in zip(known, tile.tolist()):
        members.setdefault(t, []).append(r)
    least = {t: np.stack([np.frombuffer(r["least"]) for r in own]) for t, own in members.items()}
    cell_of = {t: np.array([r["cell"] for r in own]) for t, own in members.items()}

    def near(i: int, j: int) -> bool:
        if members[i][0]["dim"] != dim:
            return True
        a, b = cell_of[i], cell_of[j]
        return bool((least[i][:, b] + least[j][:, a].T <= cells.most).any())

    pairs = [(i, j) for i in members for j in members if i <= j and members[i][0]["dim"] == members[j][0]["dim"] and near(i, j)]

    def compare(data: pa.Table) -> pa.Table:
        both: dict[int, list[dict]] = {}
        for r in data.to_pylist():
            r["x"] = unpack_block(r.pop("unit"), len(r["rep"]) // 8, r["dim"])
            r |= {c: np.frombuffer(r[c], np.int64) for c in ("rep", "copies")} | {"least": np.frombuffer(r["least"])}
            both.setdefault(r["tile"], []).append(r)
        i, j = min(both), max(both)
        out: list[tuple] = []
        for at, a in enumerate(both[i]):
            for b in both[j][at:] if i == j else both[j]:
                out += links_between(a, b)
        names, kinds = ("a", "b", "n"), (pa.int64(),) * 3
        columns = list(zip(*out)) if out else [()] * 3
        return pa.table({c: pa.array(v, t) for c, v, t in zip(names, columns, kinds)})

    def links_between(a: dict, b: dict) -> list[tuple]:
        """(vector, null, links) and (vector, smallest vector, null) of two blocks, which may be the same."""
        own, other = slice(None), slice(None)
        if a["cell"] != b["cell"]:
            most = shared.value.most
            if a["least"][b["cell"]] + b["least"][a["cell"]] > most:
                return []
            own = np.flatnonzero(shared.value.distances(a["x"], a["cell"], [b["cell"]])[:, 0] + b["least"][a["cell"]] <= most)
            other = np.flatnonzero(shared.value.distances(b["x"], b["cell"], [a["cell"]])[:, 0] + a["least"][b["cell"]] <= most)
        x, y = a["x"][own], b["x"][other]
        ids, other_ids, weights, other_weights = a["rep"][own], b["rep"][other], a["copies"][own], b["copies"][other]
        linked = np.empty((len(x), len(y)), bool)
        for first in range(0, len(x), 256):
            np.greater_equal(x[first : first + 256] @ y.T, threshold, out=linked[first : first + 256])
        if a is b:
            np.fill_diagonal(linked, False)
        out = []
        for who, n in ((ids, linked @ other_weights), (other_ids, weights @ linked)):
            at = np.flatnonzero(n)
            out += zip(who[at].tolist(), [None] * len(at), n[at].tolist())
            if a is b:
                break
        return out + [(u, v, None) for u, v in forest(linked, ids, other_ids)]

    def met(wave: list[tuple[int, int]]) -> DataFrame:
        deal = [(r["dim"], r["cell"], r["block"], t, i, j) for i, j in wave for t in sorted({i, j}) for r in members[t]]
        deal = local_frame(spark, deal, "dim int, cell int, block int, tile long, i long, j long")
        return blocks.join(F.broadcast(deal), ["dim", "cell", "block"]).groupBy("i", "j").applyInArrow(compare, "a long, b long, n long")

    # tile pairs meet over their numbers; a group holds two tiles at most
    bytes_of_tile = sum(r["bytes"] for r in known) / max(len(members), 1)
    found = materialize_all(map(met, [*waves(pairs, len(members), bytes_of_tile)] or [[]]), "found")
    discard(blocks)
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    roots = components(found.where("b IS NOT NULL")).select(F.col("node").alias("rep"), "root")
    # a component's id is the smallest of its classes; copies share their class's links and component
    labelled = classes.select("key", "rep", "least", "copies").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    labelled = materialize(labelled.join(counts, "rep", "left"), "labelled")
    smallest_id = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    per_class = labelled.join(smallest_id, "root").select("key", links.cast("long").alias("n_links"), "component_id")
    linked = valid.select("id", "key").join(per_class, "key").select(F.col("id").alias("vec_id"), "n_links", "component_id")
    alone = rows.where("key IS NULL").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
