"""Document fingerprints by MinHash, and near-duplicate pairs from banded signatures.

A text's five-word shingles (case-folded ASCII, words between ASCII white space) are hashed to 64
bits; each of ``PERMUTATIONS`` universal hash functions a * x + b keeps its minimum over the
shingles. The fingerprint is the sequence of minima, 16 bits each, as hexadecimal digits; the
likeness of two fingerprints is the share of equal places, an estimate of the Jaccard similarity.

Near-duplicate search: texts of equal shingle sets form a class; bands of the signature are joined in
Spark, and all classes of a bucket are compared on their whole shingle sets: in pairs where a bucket has
few, else in salted blocks that multiply documents by shingles. A linked pair is missed only if no band
of its signatures agrees (at a similarity of 0.8 one in 4,000 pairs, with 16 bands of 4).

Defined results: a null text is empty; a text of fewer than five words has one shingle made of all of
them; a text without words has no shingles and the fingerprint of ``ffff`` places, which is like itself
(1) and unlike every other (0), and is linked with nothing. Repeated rows give repeated results.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopwise.llm import ngram_join
from stopwise.llm.graph import components
from stopwise.llm.hashing import column_bytes, mix64, shingle_hashes, word_hashes
from stopwise.llm.worker import released, sliced
from stopwise.session import materialize

PERMUTATIONS = 64
BANDS = 16
K = 5
_seeds = mix64(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_A, _B = _seeds[:PERMUTATIONS] | np.uint64(1), _seeds[PERMUTATIONS:]
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(texts: list[bytes], k: int = K) -> np.ndarray:
    """(texts x PERMUTATIONS) minima; all ones for a text without words."""
    out = np.full((len(texts), PERMUTATIONS), NONE)
    for first, words, counts in word_hashes(texts):
        shingles, sizes = shingle_hashes(words, counts, k)
        some = np.flatnonzero(sizes)
        if not len(some):
            continue
        starts = (np.cumsum(sizes) - sizes)[some]
        for p in range(PERMUTATIONS):
            out[first + some, p] = np.minimum.reduceat(shingles * _A[p] + _B[p], starts)
    return out


def packed(signature: np.ndarray) -> np.ndarray:
    """16 bits of each minimum. The top bits of a minimum say little, so they are mixed first."""
    low = (mix64(signature) >> np.uint64(48)).astype(np.uint16)
    low[signature == NONE] = 0xFFFF
    return low


def as_text(low: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in low]


def likeness(a: np.ndarray, b: np.ndarray, empty_a: np.ndarray, empty_b: np.ndarray) -> np.ndarray:
    """Share of equal places; two texts without words are alike, one with and one without are not."""
    same = (a == b).mean(1)
    return np.where(empty_a | empty_b, (empty_a & empty_b).astype(float), same)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
EDGE = ", part int, edge string, text string"
GROUP_CHARS = 4_000_000


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(ids: list[int], texts: list[str], following: list[str]) -> list[list]:
    """Columns of RESULT for documents and the texts that follow them."""
    edited = [_edited(a, b) for a, b in zip(texts, following)]
    raw = [t.encode("utf-8", "replace") for t in edited]
    # a document's successor is mostly the next one here: sign each text once
    place: dict[int, int] = {}
    distinct: list[bytes] = []
    def at(text: str) -> int:
        if id(text) not in place:
            place[id(text)] = len(distinct)
            distinct.append(text.encode("utf-8", "replace"))
        return place[id(text)]
    own, nxt = [at(t) for t in texts], [at(t) for t in following]
    whole = signatures(distinct)
    changed = signatures(raw)
    low, changed_low = packed(whole), packed(changed)
    empty, changed_empty = whole[:, 0] == NONE, changed[:, 0] == NONE
    prints = as_text(low)
    return [
        ids,
        [len(t) for t in texts],
        [hashlib.sha256(r).hexdigest() for r in raw],
        [prints[i] for i in own],
        as_text(changed_low),
        likeness(low[own], changed_low, empty[own], changed_empty).tolist(),
        likeness(low[own], low[nxt], empty[own], empty[nxt]).tolist(),
    ]


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Every document compared with its half-edited text and with the next document by doc_id (see RESULT).

    Documents are dealt out by ranges of doc_id and sorted there, so all but the last of a range find
    their successor in the same task. Of each range, the first text and the last document are kept as
    two more rows; these few rows are then joined by the order of the ranges. Rows with equal doc_id
    follow each other in the order of their texts.
    """
    kept = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    both = ranged.withColumn("part", F.spark_partition_id())
    names = [part.split()[0] for part in (RESULT + EDGE).split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "string": pa.string()}
    types = [kinds[part.split()[1]] for part in (RESULT + EDGE).split(", ")]

    def batch(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def edge(part: int, kind: str, doc: int | None, text: str) -> pa.RecordBatch:
        return batch([[doc], [None], [None], [None], [None], [None], [None], [part], [kind], [text]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[str] = []
        chars, part = 0, None
        for rows in batches:
            for doc, text, number in zip(*(c.to_pylist() for c in rows.columns)):
                if part is None:
                    part = number
                    yield edge(part, "first", doc, text)
                ids.append(doc)
                texts.append(text)
                chars += len(text)
                if chars >= GROUP_CHARS and len(ids) > 1:
                    columns = _compare(ids[:-1], texts[:-1], texts[1:])
                    n = len(ids) - 1
                    yield batch([*columns, [part] * n, [None] * n, [None] * n])
                    ids, texts, chars = ids[-1:], texts[-1:], len(texts[-1])
        if len(ids) > 1:
            n = len(ids) - 1
            yield batch([*_compare(ids[:-1], texts[:-1], texts[1:]), [part] * n, [None] * n, [None] * n])
        if ids:
            yield edge(part, "last", ids[-1], texts[-1])

    found = materialize(both.mapInArrow(run, RESULT + EDGE), "compared")
    firsts = found.where("edge = 'first'").select("part", F.col("text").alias("following"))
    # one row per range: its successor is the next range that has documents, after the last comes the first
    order = Window.orderBy("part")
    numbers = found.where("edge = 'first'").select("part")
    numbers = numbers.withColumn("to", F.lead("part").over(order)).withColumn("lowest", F.min("part").over(Window.partitionBy(F.lit(0))))
    numbers = numbers.select("part", F.coalesce("to", "lowest").alias("to"))
    lasts = found.where("edge = 'last'").select("part", "doc_id", "text")
    closing = lasts.join(numbers, "part").join(firsts.withColumnRenamed("part", "to"), "to").select("doc_id", "text", "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for doc, text, following in zip(*(c.to_pylist() for c in rows.columns)):
                columns = _compare([doc], [text], [following])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names[: len(columns)])

    return found.where("edge IS NULL").select(*names[:7]).union(closing.mapInArrow(close, RESULT))


def near_links(docs: DataFrame, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Classes of equal shingle sets, and the verified links between classes that share a band.

    Returns ``doc_id, class`` (the smallest id with the same set; null without words or without an id), one row
    per row of ``docs``, and ``a, b, jaccard`` with a < b. A bucket of up to ``PAIRED`` classes is compared pair
    by pair. Classes that larger buckets tie together are compared by blocks, all with all, so none of their
    links is lost; of these a forest is returned, each class with the smallest one that its block's links reach,
    without a similarity.
    """
    threshold = ngram_join.Threshold(num, den)
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sized = materialize(ngram_join.set_sizes(kept, K, threshold), "sets")
    same = sized.where("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("class"))
    info = materialize(sized.join(same, ["h1", "h2", "n"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("class")), "classes")
    sizes = info.where("doc_id = class").select("class", "n").distinct()
    rows = PERMUTATIONS // BANDS

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            signature = signatures(column_bytes(batch.column(1)))
            some = signature[:, 0] != NONE
            ids = np.asarray(batch.column(0))[some]
            for band in range(BANDS):
                key = np.full(len(ids), np.uint64(band))
                for r in range(rows):
                    key = mix64(key + signature[some, band * rows + r])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids)], ["bucket", "doc_id"])

    found = kept.where("doc_id IS NOT NULL").mapInArrow(released(bands), "bucket long, doc_id long")
    # an id may repeat with other texts, so its bands may point to classes that are not its own; verification decides
    members = materialize(found.join(sizes, F.col("doc_id") == F.col("class")).select("bucket", "class", "n").distinct(), "members")
    buckets = members.groupBy("bucket").agg(F.count("*").alias("classes"), F.min("class").alias("first")).where("classes > 1")
    open_ = materialize(members.join(buckets, "bucket"), "buckets")
    tied = materialize(open_.where(F.col("classes") > ngram_join.PAIRED).select("class", "first").distinct(), "tied")
    families = components(tied, "class", "first").select(F.col("node").alias("class"), "root")
    wide = tied.select("class").distinct().join(families, "class", "left").withColumn("root", F.coalesce("root", "class"))
    dense = ngram_join._products(materialize(wide.join(sizes, "class"), "families"), kept, K, threshold)
    small = open_.where(F.col("classes") <= ngram_join.PAIRED)
    side = lambda name: small.select("bucket", F.col("class").alias(name), F.col("n").alias(f"n_{name}"))
    bound = F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num
    pairs = side("a").join(side("b"), "bucket").where((F.col("a") < F.col("b")) & bound).select("a", "b", "n_a", "n_b").distinct()
    shared = ngram_join._overlaps(materialize(pairs, "candidates"), kept, K)
    union = F.col("n_a") + F.col("n_b") - F.col("shared")
    near = shared.where(F.col("shared") * den >= union * num).select("a", "b", (F.col("shared") / union).alias("jaccard"))
    forest = dense.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(None).cast("double").alias("jaccard"))
    return info.select("doc_id", "class"), materialize(near.union(forest), "near")


def near_pairs(docs: DataFrame, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``a, b, jaccard`` with a < b: every copy with its class, and the links between classes (see ``near_links``)."""
    info, links = near_links(docs, num, den, id_col, text_col)
    copies = info.where("doc_id > class").select(F.col("class").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("jaccard"))
    return links.union(copies.distinct())


def near_groups(docs: DataFrame, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, group_id`` of every row: the smallest id reachable over verified links; texts without words are alone."""
    info, links = near_links(docs, num, den, id_col, text_col)
    roots = components(links).select(F.col("node").alias("class"), "root")
    return info.join(roots, "class", "left").select("doc_id", F.coalesce("root", "class", "doc_id").alias("group_id"))
