"""N-gram Jaccard join by vertical partitioning, and the components of its links.

The global order of n-grams is that of their 64-bit hashes. Cutting it at fixed points cuts every
document's n-gram set into fragments, and everything below works on fragments:

* Candidates. Two sets with similarity t differ in at most k n-grams, where k follows from their
  sizes. Cut into k + 1 + s fragments, at least 1 + s fragments agree entirely; so documents are candidates
  when a fragment, as a whole, is equal. Passages or n-grams that very many documents share don't
  make candidates of them, as a whole fragment has to agree. Size classes (growing by the factor 1 / t)
  give the number of fragments; a document is cut for its own class and for the next larger one, so
  any pair within the size bound is cut alike once. Empty fragments agree with all others, so they
  make no candidates; a set with more than s of them is cut again by another hash (up to 8 times, after
  that its empty fragments count), and a pair that agrees in empty fragments only has both sets cut again.
* Overlaps. For a candidate pair the fragments of both sets (a coarse cut) are joined, each fragment's
  overlap is counted separately, and the counts are summed per pair. Links are exact.

Documents with equal sets form a class and only its smallest document takes part. Links are found in
two steps: first every class is compared with the smallest class of its best fragment group, which
joins near copies into components; then all remaining candidates between different components are
compared, so no link between components is lost. Fragments of few documents give candidate pairs. A
fragment of more than ``PAIRED`` documents would list their square; the documents of such fragments are
put into blocks instead, a task multiplies two blocks fragment by fragment (documents x n-grams), sums the
partial overlaps in place, and returns a spanning forest of the links only.

Defined results: words are maximal runs without ASCII white space, A-Z lower-cased. A text with fewer
than k words has one n-gram of all of them. A null or blank text has no n-gram and no link; its
component is its own id. A row with a null id links nothing; it is returned with the component of the
documents that have its set, or a null one. Equal rows count as one document and are all returned; an id is taken to name one text. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.llm.graph import components, forest
from stopwise.llm.hashing import column_bytes, mix64, shingle_hashes, word_hashes
from stopwise.llm.worker import released, sliced
from stopwise.session import discard, materialize

SLACK, CUTS = 1, 8
#: A fragment with more documents (classes) than this is compared by blocks of about ``BLOCK_GRAMS`` n-grams and at most
#: about ``BLOCK_DOCS`` documents, which bounds a block's matrix of documents.
PAIRED, BLOCK_GRAMS, BLOCK_DOCS = 24, 300_000, 2048
#: Keys that are packed together.
PACKED = 500_000
#: Coarse fragments for counting overlaps.
FRAGMENTS = 4
#: So many ids at most are broadcast (8 bytes each).
BROADCAST_IDS = 2_000_000
_U = np.uint64


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity num / den."""

    num: int
    den: int

    def classes(self, largest: int) -> np.ndarray:
        """Upper sizes of the size classes, up to one beyond ``largest``."""
        upper = [1]
        while upper[-1] < largest:
            upper.append(max(upper[-1] + 1, upper[-1] * self.den // self.num))
        upper.append(max(upper[-1] + 1, upper[-1] * self.den // self.num))
        return np.array(upper, np.int64)

    def differences(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Most n-grams in which two linked sets of at most these sizes can differ."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)


def _sets(texts: list[bytes], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, sorted distinct n-grams of each text one after the other, set sizes)."""
    for first, words, counts in word_hashes(texts):
        grams, sizes = shingle_hashes(words, counts, k)
        ends = np.cumsum(sizes)
        for a, b in zip((ends - sizes).tolist(), ends.tolist()):
            grams[a:b].sort()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        fresh = np.ones(len(grams), bool)
        fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        yield first, grams[fresh], np.bincount(owner[fresh], minlength=len(sizes))


def _digest(grams: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set; 0 for an empty one."""
    some = np.flatnonzero(sizes)
    out = np.zeros((2, len(sizes)), np.uint64)
    if len(some):
        starts = (np.cumsum(sizes) - sizes)[some]
        out[0, some] = np.add.reduceat(mix64(grams), starts)
        out[1, some] = np.add.reduceat(mix64(grams ^ _U(0xA5A5A5A5A5A5A5A5)), starts)
    return out[0], out[1]


def _fragment_keys(grams: np.ndarray, sizes: np.ndarray, threshold: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the fragments of each set, and the position of the set each key belongs to."""
    keys, owners = [], []
    upper = threshold.classes(int(sizes.max(initial=1)))
    own = np.searchsorted(upper, sizes)
    starts = np.cumsum(sizes) - sizes
    for step in (0, 1):
        tag = own + step
        lower = upper[np.maximum(tag - 1, 0)]
        most = threshold.differences(lower, upper[tag])
        # allow three times the empty fragments that are to be expected, so that few sets are cut again
        slack = SLACK + np.ceil(3 * (most + 1) * np.exp(-lower / (most + 1))).astype(np.int64)
        pieces = np.where((most > 0) & (sizes > 0), most + 1 + slack, 0)
        todo = np.flatnonzero(pieces)
        for cut in range(CUTS):
            if not len(todo):
                break
            n = sizes[todo]
            place = np.repeat(starts[todo] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            values, owner = grams[place], np.repeat(np.arange(len(todo)), n)
            if cut:
                values = mix64(values + _U(cut))
                order = np.lexsort((values, owner))
                values = values[order]
            m = pieces[todo]
            fragment = (values >> _U(32)) * m[owner].astype(np.uint64) >> _U(32)
            head = np.ones(len(values), bool)
            head[1:] = (fragment[1:] != fragment[:-1]) | (owner[1:] != owner[:-1])
            first = np.flatnonzero(head)
            salt = mix64(tag[todo[owner[first]]].astype(np.uint64) * _U(64) + _U(cut))
            keys.append(mix64(np.add.reduceat(mix64(values), first) + mix64(fragment[first] + salt)))
            owners.append(todo[owner[first]])
            filled = np.bincount(owner[first], minlength=len(todo))
            bad = m - filled > slack[todo]
            if cut == CUTS - 1 and bad.any():
                taken = set(zip(owner[first].tolist(), fragment[first].tolist()))
                for i in np.flatnonzero(bad).tolist():
                    salt = mix64(np.array([tag[todo[i]] * 64 + cut], np.uint64))
                    empty = np.array([f for f in range(int(m[i])) if (i, f) not in taken], np.uint64)
                    keys.append(mix64(mix64(empty + salt)))
                    owners.append(np.full(len(empty), todo[i]))
            todo = todo[bad]
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def _pack(keys: np.ndarray, docs: np.ndarray) -> tuple[bytes, bytes]:
    """Six bytes of each key (its range is known besides), and the ids as differences where these are small."""
    steps = np.diff(docs, prepend=np.int64(0))
    small = np.abs(steps[1:]).max(initial=0) < 1 << 31
    ids = docs[:1].tobytes() + steps[1:].astype(np.int32).tobytes() if small else b"\0" * 7 + docs.tobytes()
    return keys.view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), ids


def _unpack(keys: bytes, docs: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(keys) // 6
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :6] = np.frombuffer(keys, np.uint8).reshape(n, 6)
    if len(docs) == 8 + 4 * (n - 1):
        first = np.frombuffer(docs[:8], np.int64)
        ids = np.cumsum(np.concatenate((first, np.frombuffer(docs[8:], np.int32))))
    else:
        ids = np.frombuffer(docs[7:], np.int64)
    return wide.view(np.int64).ravel(), ids


def set_sizes(docs: DataFrame, k: int, threshold: Threshold) -> DataFrame:
    """``doc_id, n, cap, h1, h2``: size and digest of every row's set; cap: see ``votes_needed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n, h1, h2 = [], [], []
            for _, grams, sizes in _sets(column_bytes(batch.column(1)), k):
                a, b = _digest(grams, sizes)
                n.append(sizes)
                h1.append(a.view(np.int64))
                h2.append(b.view(np.int64))
            n, h1, h2 = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (n, h1, h2))
            upper = threshold.classes(int(n.max(initial=1)))
            own = np.searchsorted(upper, n)
            cap = threshold.differences(upper[own], upper[own + 1])
            columns = [batch.column(0), *map(pa.array, (n, cap, h1, h2))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "cap", "h1", "h2"])

    return docs.mapInArrow(released(run), "doc_id long, n long, cap long, h1 long, h2 long")


def votes_needed(threshold: Threshold) -> Column:
    """Fewest equal fragments of a linked pair (a, n_a, cap_a, b, n_b, cap_b).

    In the cut for the smaller set's class there are cap + 1 + s fragments. At most as many as the
    pair's sizes allow differ, and s of the equal ones are empty.
    """
    cap = F.when(F.col("n_a") <= F.col("n_b"), F.col("cap_a")).otherwise(F.col("cap_b"))
    most = F.floor((F.col("n_a") + F.col("n_b")) * (threshold.den - threshold.num) / F.lit(threshold.den + threshold.num))
    return cap - most + 1


def fragment_groups(docs: DataFrame, k: int, threshold: Threshold) -> DataFrame:
    """``key, doc_id`` of the fragments that at least two ids have, each id once.

    Keys travel as packed arrays, dealt out by key range; copies inside a task are sent once.
    """
    ranges = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def deal(keys: list[np.ndarray], owners: list[np.ndarray]) -> pa.RecordBatch:
        key, owner = np.concatenate(keys), np.concatenate(owners)
        part = ((key >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        key, owner, part = key[order], owner[order], part[order]
        cuts = np.searchsorted(part, np.arange(ranges + 1))
        some = [r for r in range(ranges) if cuts[r] < cuts[r + 1]]
        both = [_pack(key[cuts[r] : cuts[r + 1]], owner[cuts[r] : cuts[r + 1]]) for r in some]
        columns = [pa.array(some, pa.int32()), *(pa.array([x[i] for x in both], pa.binary()) for i in (0, 1))]
        return pa.RecordBatch.from_arrays(columns, ["part", "keys", "docs"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        keys, owners, n = [], [], 0
        for batch in sliced(batches):
            ids = np.asarray(batch.column(0))
            for first, grams, sizes in _sets(column_bytes(batch.column(1)), k):
                new = np.zeros(len(sizes), bool)
                for i, digest in enumerate(zip(*(x.tolist() for x in _digest(grams, sizes)))):
                    if sizes[i] and digest not in seen:
                        seen.add(digest)
                        new[i] = True
                grams, sizes = grams[np.repeat(new, sizes)], np.where(new, sizes, 0)
                key, owner = _fragment_keys(grams, sizes, threshold)
                keys.append(key)
                owners.append(ids[first + owner])
                n += len(key)
                if n >= PACKED:
                    yield deal(keys, owners)
                    keys, owners, n = [], [], 0
        if n:
            yield deal(keys, owners)

    def group(data: pa.Table) -> pa.Table:
        # the low six bytes travel: keys of one range that agree in them count as equal, which at worst makes a candidate
        both = [_unpack(a.as_py(), b.as_py()) for a, b in zip(data.column("keys"), data.column("docs"))]
        key, doc = np.concatenate([x[0] for x in both]), np.concatenate([x[1] for x in both])
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        key, doc = key[fresh], doc[fresh]
        head = np.ones(len(key) + 1, bool)
        head[1:-1] = key[1:] != key[:-1]
        shared = ~(head[:-1] & head[1:])
        part = data.column("part")[0].as_py()
        return pa.table({"key": key[shared] | np.int64(part << 48), "doc_id": doc[shared]})

    packed = docs.mapInArrow(released(cut), "part int, keys binary, docs binary")
    return packed.groupBy("part").applyInArrow(group, "key long, doc_id long")


def fragments(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, fragment, grams``: the coarse fragments of every row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids = np.asarray(batch.column(0))
            for first, grams, sizes in _sets(column_bytes(batch.column(1)), k):
                owner = np.repeat(np.arange(len(sizes)), sizes)
                fragment = ((grams >> _U(32)) * _U(FRAGMENTS) >> _U(32)).astype(np.int64)
                head = np.ones(len(grams), bool)
                head[1:] = (fragment[1:] != fragment[:-1]) | (owner[1:] != owner[:-1])
                at = np.flatnonzero(head)
                lists = pa.ListArray.from_arrays(np.append(at, len(grams)).astype(np.int32), grams.view(np.int64))
                columns = [pa.array(ids[first + owner[at]]), pa.array(fragment[at].astype(np.int32)), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fragment", "grams"])

    return docs.mapInArrow(released(run), "doc_id long, fragment int, grams array<long>")


def representatives(docs: DataFrame, info: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id stands for its class in ``info`` (doc_id, class).

    The fewer ids, theirs or those of the copies, are sent to the tasks, which spares the texts a shuffle.
    """
    ids = info.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("class")).alias("first"))
    ids = materialize(ids.where("first IS NOT NULL"), "firsts")
    n = {r["first"]: r["count"] for r in ids.groupBy("first").count().collect()}
    first = n.get(True, 0) <= n.get(False, 0)
    some = ids.where(F.col("first") == first).select("doc_id")
    some = F.broadcast(some) if n.get(first, 0) <= BROADCAST_IDS else some
    return docs.join(some, "doc_id", "left_semi" if first else "left_anti")


def _parts(needed: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Fragments of the documents in ``needed`` (doc_id)."""
    needed = materialize(needed.distinct(), "needed")
    # few ids spare the texts a shuffle; their number is known, as they are written
    some = F.broadcast(needed) if needed.count() <= BROADCAST_IDS else needed
    return materialize(fragments(docs.join(some, "doc_id", "left_semi"), k), "fragments")


def _alive(classes: DataFrame, parts: DataFrame, threshold: Threshold) -> DataFrame:
    """Those of ``classes`` (class, n) that can link to another one: enough of their n-grams lie in other sets of ``parts`` too."""
    grams = parts.select("doc_id", F.explode("grams").alias("gram"))
    shared = grams.groupBy("gram").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    # repeated rows only add to the count, and n-grams of the whole are at least those shared with any one set
    counts = grams.join(shared.select("gram"), "gram").groupBy(F.col("doc_id").alias("class")).agg(F.count("*").alias("shared"))
    return classes.join(counts, "class").where(F.col("shared") * threshold.den >= F.col("n") * threshold.num).select("class", "n")


def _products(groups: DataFrame, docs: DataFrame, k: int, threshold: Threshold, parts: DataFrame | None = None) -> DataFrame:
    """Links ``a, b`` (a spanning forest) among the classes of each group; ``groups`` has root, class, n.

    parts: ``fragments`` that have those of all the classes, if they are known.
    """
    total = F.greatest(F.ceil(F.sum("n") / BLOCK_GRAMS), F.ceil(F.count("*") / BLOCK_DOCS)).cast("int").alias("blocks")
    blocked = groups.join(groups.groupBy("root").agg(total), "root")
    blocked = blocked.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    parts = parts or _parts(groups.select(F.col("class").alias("doc_id")), docs, k)
    rows = blocked.join(parts, F.col("class") == F.col("doc_id")).select("root", "blocks", "block", "class", "n", "fragment", "grams")

    def pack(data: pa.Table) -> pa.Table:
        data = data.sort_by([("fragment", "ascending"), ("class", "ascending")])
        grams = data.column("grams").combine_chunks()
        raw = {"class": data.column("class"), "n": data.column("n"), "fragment": data.column("fragment")}
        out = {c: pa.array([np.asarray(v).astype(np.int64).tobytes()], pa.binary()) for c, v in raw.items()}
        out["sizes"] = pa.array([np.diff(np.asarray(grams.offsets)).astype(np.int64).tobytes()], pa.binary())
        out["grams"] = pa.array([np.asarray(grams.flatten()).tobytes()], pa.binary())
        return pa.table({c: data.column(c)[:1] for c in ("root", "blocks", "block")} | out)

    schema = "root long, blocks int, block int, class binary, n binary, fragment binary, sizes binary, grams binary"
    blocks = materialize(rows.groupBy("root", "block").applyInArrow(pack, schema), "blocks")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    dealt = blocks.withColumn("p", F.explode(meets)).select("*", "p.i", "p.j").drop("p", "blocks")

    def compare(data: pa.Table) -> pa.Table:
        sides = []
        for row in sorted(data.to_pylist(), key=lambda r: r["block"]):
            ids, n, fragment, sizes = (np.frombuffer(row[c], np.int64) for c in ("class", "n", "fragment", "sizes"))
            classes, at = np.unique(ids, return_index=True)
            owner = np.repeat(np.searchsorted(classes, ids), sizes)
            sides.append((classes, n[at], owner, np.repeat(fragment, sizes), np.frombuffer(row["grams"], np.int64)))
        (a, n_a, own_a, frag_a, grams_a), (b, n_b, own_b, frag_b, grams_b) = sides[0], sides[-1]
        shared = np.zeros((len(a), len(b)), np.float32)
        for f in range(FRAGMENTS):
            x, y = grams_a[frag_a == f], grams_b[frag_b == f]
            common = np.intersect1d(x, y)
            if len(sides) == 1:  # n-grams of one document only add to the diagonal
                values, seen = np.unique(x, return_counts=True)
                common = values[seen > 1]
            place_x, place_y = np.searchsorted(common, x), np.searchsorted(common, y)
            in_x = np.flatnonzero(np.append(common, 0)[place_x] == x) if len(common) else np.empty(0, np.int64)
            in_y = np.flatnonzero(np.append(common, 0)[place_y] == y) if len(common) else np.empty(0, np.int64)
            in_x, in_y = in_x[place_x[in_x] < len(common)], in_y[place_y[in_y] < len(common)]
            row_x, col_x = own_a[frag_a == f][in_x], place_x[in_x]
            row_y, col_y = own_b[frag_b == f][in_y], place_y[in_y]
            for first in range(0, len(common), 2048):
                dense = []
                for rows, cols, n in ((row_x, col_x, len(a)), (row_y, col_y, len(b))):
                    here = (cols >= first) & (cols < first + 2048)
                    m = np.zeros((n, 2048), np.float32)
                    m[rows[here], cols[here] - first] = 1
                    dense.append(m)
                shared += dense[0] @ dense[1].T
        linked = np.empty(shared.shape, bool)
        for i in range(0, len(a), 256):
            both = shared[i : i + 256].astype(np.int64)
            linked[i : i + 256] = both * threshold.den >= (n_a[i : i + 256, None] + n_b[None] - both) * threshold.num
        if len(sides) == 1:
            np.fill_diagonal(linked, False)
        found = forest(linked, a, b)
        return pa.table({c: pa.array([x[i] for x in found], pa.int64()) for i, c in enumerate(("a", "b"))})

    return dealt.groupBy("root", "i", "j").applyInArrow(compare, "a long, b long")


def _sides(pairs: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    return _parts(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), docs, k)


def _overlaps(pairs: DataFrame, docs: DataFrame, k: int, parts: DataFrame | None = None) -> DataFrame:
    """``pairs`` (a, n_a, b, n_b) with ``shared``: overlaps by fragment, summed per pair."""
    parts = parts or _sides(pairs, docs, k)
    left = parts.select(F.col("doc_id").alias("a"), "fragment", F.col("grams").alias("x"))
    right = parts.select(F.col("doc_id").alias("b"), "fragment", F.col("grams").alias("y"))
    both = pairs.join(left, "a").join(right, ["b", "fragment"])
    # repeated rows bring equal fragments twice, so a fragment's overlap is a maximum
    partial = both.groupBy("a", "b", "n_a", "n_b", "fragment").agg(F.max(F.size(F.array_intersect("x", "y"))).alias("shared"))
    return partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("shared").alias("shared"))


def _links(pairs: DataFrame, docs: DataFrame, k: int, threshold: Threshold, name: str) -> DataFrame:
    """The linked ones of ``pairs`` (a, n_a, b, n_b), written; the sets read for them are deleted."""
    union = F.col("n_a") + F.col("n_b") - F.col("shared")
    parts = _sides(pairs, docs, k)
    found = _overlaps(pairs, docs, k, parts).where(F.col("shared") * threshold.den >= union * threshold.num)
    found = materialize(found.select("a", "b"), name)
    discard(parts)
    return found


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """Classes and links of ``docs`` (doc_id, text).

    Returns ``doc_id, n, class`` (class: smallest id with the same set; null for an empty set), one row
    per row of docs, and links ``a, b`` between classes that have the components of all links.
    """
    threshold = Threshold(num, den)
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sized = materialize(set_sizes(kept, k, threshold), "sets")
    same = sized.where("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("class"))
    info = materialize(sized.join(same, ["h1", "h2", "n"], "left").select("doc_id", "n", "cap", "class"), "classes")
    # fragment groups of the classes' first documents
    firsts = representatives(kept.where("doc_id IS NOT NULL"), info)
    groups = materialize(fragment_groups(firsts, k, threshold).withColumnRenamed("doc_id", "class"), "groups")
    heads = groups.groupBy("key").agg(F.min("class").alias("head"), F.max("class").alias("last")).where("head < last")
    sizes = info.where("doc_id = class").select("class", "n", "cap").distinct()
    size_of = lambda side: sizes.select(F.col("class").alias(side), F.col("n").alias(f"n_{side}"), F.col("cap").alias(f"cap_{side}"))
    bound = F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num
    # first step: the head with which a class shares most fragments
    votes = groups.join(heads, "key").where("class > head").groupBy("class", "head").agg(F.count("*").alias("votes"))
    best = votes.groupBy("class").agg(F.max(F.struct("votes", -F.col("head"), F.col("head").alias("head"))).alias("best"))
    stars = best.select(F.col("best.head").alias("a"), F.col("class").alias("b"), F.col("best.votes").alias("votes"))
    stars = stars.join(size_of("a"), "a").join(size_of("b"), "b").where(bound)
    # its votes are only those of groups with this head, so half of what a link needs is worth a look
    stars = materialize(stars.where(2 * F.col("votes") >= votes_needed(threshold)).select("a", "b", "n_a", "n_b"), "stars")
    near = _links(stars, kept, k, threshold, "near")
    labels = components(near)
    # second step: candidates between different components
    placed = groups.join(labels.select(F.col("node").alias("class"), "root"), "class", "left")
    placed = placed.select("key", "class", F.coalesce("root", "class").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("classes"))
    open_ = materialize(placed.join(mixed.where("low < high").select("key", "classes"), "key"), "open")
    # fragments of many documents: those that such fragments connect are compared by blocks
    wide = open_.where(F.col("classes") > PAIRED)
    classes = materialize(wide.select("class").distinct().join(sizes.select("class", "n"), "class"), "wide")
    parts = _parts(classes.select(F.col("class").alias("doc_id")), kept, k)
    members = materialize(_alive(classes, parts, threshold), "alive")
    wide = wide.join(members.select("class"), "class")
    first = wide.groupBy("key").agg(F.min("class").alias("first"))
    tied = materialize(wide.join(first, "key").select("class", "first").distinct(), "tied")
    families = components(tied, "class", "first").select(F.col("node").alias("class"), "root")
    members = members.join(families, "class", "left").withColumn("root", F.coalesce("root", "class"))
    dense = materialize(_products(materialize(members, "families"), kept, k, threshold, parts), "dense")
    discard(parts)
    # the others: pairs. A pair that shares a wide fragment too has been compared above
    open_ = open_.where(F.col("classes") <= PAIRED)
    left = open_.select("key", F.col("class").alias("a"), F.col("comp").alias("comp_a"))
    right = open_.select("key", F.col("class").alias("b"), F.col("comp").alias("comp_b"))
    cross = left.join(right, "key").where("a < b AND comp_a != comp_b").groupBy("a", "b").agg(F.count("*").alias("votes"))
    cross = cross.join(size_of("a"), "a").join(size_of("b"), "b").where(bound & (F.col("votes") >= votes_needed(threshold)))
    cross = materialize(cross.select("a", "b", "n_a", "n_b"), "cross")
    far = _links(cross, kept, k, threshold, "far")
    return info, near.union(far).union(dense)


def component_ids(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    info, links = join(docs, k, num, den)
    roots = components(links).select(F.col("node").alias("class"), "root")
    component = F.coalesce("root", "class", "doc_id")
    return info.join(roots, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, with all columns, whose document has the smallest id of its component.

    An id that repeats keeps its smallest row; rows without an id stay.
    """
    found = component_ids(docs, k, num, den).where("doc_id = component_id").groupBy("doc_id").count()
    found = materialize(found.select(F.col("doc_id").alias("_kept"), "count"), "kept")
    few = found.count() <= BROADCAST_IDS

    def rows_of(ids: DataFrame) -> DataFrame:
        ids = ids.select("_kept")
        return docs.join(F.broadcast(ids) if few else ids, docs["doc_id"] == ids["_kept"], "left_semi")

    out = rows_of(found.where("count = 1")).union(docs.where("doc_id IS NULL"))
    repeated = found.where("count > 1")
    if repeated.isEmpty():
        return out
    smallest = rows_of(repeated).groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return out.union(smallest.select("_row.*"))
