"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Every pre-token is merged with three structures:

* a doubly linked list over byte positions (two arrays), so that a merge is O(1);
* one bucket per merge rank that holds the list positions where this merge is possible;
* a three-level bitmap over the ranks with 64 bits a word. The lowest set bit of a word is found
  with one machine-like operation, so the next rank costs three look-ups whatever the length.

Entries are never removed from a bucket when a neighbour changes: an entry is stale when the pair
at its position no longer has the bucket's rank, and is skipped when it is reached. Buckets are
heaps, since equal ranks merge from left to right. A pre-token of n bytes takes O(n log n) and never
rescans its parts, which is what makes very long pre-tokens cheap.

Defined results: a null text counts as empty; an empty text has no ids, its digests are those of
the empty string; rows are independent, so repeated rows give repeated results, and columns other
than the id and the text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stopwise.llm.worker import released, sliced

#: Longest pre-token kept in a worker's memo, and the bytes (with some 300 of Python's own an entry) after which it starts anew.
MEMO_BYTES, MEMO_HELD = 64, 24_000_000
#: Characters of text whose pre-tokens are looked up together; longer texts are taken alone and whole.
BUFFER_CHARS = 1_000_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    """Merge ranks of a tiktoken file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class RankQueue:
    """Positions by rank; the smallest rank is found through a bitmap of three levels."""

    __slots__ = ("top", "mid", "low", "buckets")

    def __init__(self) -> None:
        self.top = 0
        self.mid: dict[int, int] = {}
        self.low: dict[int, int] = {}
        self.buckets: dict[int, list] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
        else:
            self.buckets[rank] = [position]
            self._mark(rank)

    def push_many(self, rank: int, positions: np.ndarray) -> None:
        """For whole-bucket use: a bucket is then a list of arrays."""
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
        else:
            self.buckets[rank] = [positions]
            self._mark(rank)

    def _mark(self, rank: int) -> None:
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def first(self) -> int:
        """The smallest rank with entries, or -1."""
        if not self.top:
            return -1
        b = (self.top & -self.top).bit_length() - 1
        word = self.mid[b]
        a = b << 6 | (word & -word).bit_length() - 1
        word = self.low[a]
        return a << 6 | (word & -word).bit_length() - 1

    def pop(self, rank: int) -> int:
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            self._drop(rank)
        return position

    def pop_many(self, rank: int) -> np.ndarray:
        chunks = self.buckets[rank]
        self._drop(rank)
        return chunks[0] if len(chunks) == 1 else np.concatenate(chunks)

    def _drop(self, rank: int) -> None:
        del self.buckets[rank]
        a, b = rank >> 6, rank >> 12
        self.low[a] ^= 1 << (rank & 63)
        if not self.low[a]:
            self.mid[b] ^= 1 << (a & 63)
            if not self.mid[b]:
                self.top ^= 1 << b


class Codec:
    """Encoder and decoder for one vocabulary, with a bounded memo of short pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.start()
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        # every way to make a token of two others, as sorted keys
        keys, made = array("q"), array("i")
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    made.append(rank)
        order = np.argsort(np.frombuffer(keys, np.int64))
        self.pair_keys, self.pair_ranks = np.frombuffer(keys, np.int64)[order], np.frombuffer(made, np.int32)[order]

    def start(self) -> None:
        """An empty memo."""
        self.memo: dict[str, tuple[str, bytes]] = {}
        self.held = 0

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the merges of neighbouring tokens, -1 where there is none."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        # end[i] is the end of the part that starts at i; before[i] the start of the part on its left
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        # the rank of the merge possible at i with its right neighbour, -1 where there is none
        pair = [-1] * n
        queue = RankQueue()
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2], -1)
            if rank >= 0:
                pair[i] = rank
                queue.push(rank, i)
        while (rank := queue.first()) >= 0:
            i = queue.pop(rank)
            if pair[i] != rank:
                continue  # stale
            j = end[i]
            k = end[j]
            end[i] = k
            pair[j] = -1
            if k < n:
                before[k] = i
                pair[i] = new = ranks.get(piece[i : end[k]], -1)
                if new >= 0:
                    queue.push(new, i)
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                pair[h] = new = ranks.get(piece[h:k], -1)
                if new >= 0:
                    queue.push(new, h)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in self.pieces(text):
            ids += self.merge(piece.encode("utf-8", "replace"))
        return ids

    def learn(self, pieces: set[str]) -> None:
        """Memo entries for pre-tokens; the short ones are merged together through one queue."""
        raw = {piece: piece.encode("utf-8", "replace") for piece in pieces}
        short = [piece for piece, own in raw.items() if len(own) <= MEMO_BYTES]
        for piece, ids in zip(short, self.merge_many([raw[piece] for piece in short])):
            self.memo[piece] = ",".join(map(str, ids)), self.decode(ids)
            self.held += 300 + 4 * len(raw[piece])
        for piece in raw.keys() - set(short):
            ids = self.merge(raw[piece])
            self.memo[piece] = ",".join(map(str, ids)), self.decode(ids)

    def merge_many(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of many pre-tokens at once.

        All of them lie behind each other in one buffer. A bucket is taken as a whole, and the
        leftmost live entry of every pre-token in it is merged in one array operation; the others go
        back to the bucket, so a smaller rank that a merge makes possible comes first, as it would
        in a queue of the pre-token's own.
        """
        if not pieces:
            return []
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(flat)
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), size)
        last = np.cumsum(size) - 1
        token = np.append(self.single[flat], np.int32(0))
        after = np.arange(1, n + 2, dtype=np.int32)
        after[last] = n
        before = np.arange(-1, n, dtype=np.int32)
        before[:-1][last[:-1] + 1] = -1
        before[0] = -1
        pair = np.full(n + 1, -1, np.int32)
        live = np.ones(n + 1, bool)
        at = np.flatnonzero(after[:n] < n).astype(np.int32)
        pair[at] = self.lookup(token[at], token[after[at]])
        queue = RankQueue()

        def push(ranks: np.ndarray, positions: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            heads = ranks[np.concatenate(([0], cuts))].tolist()
            bounds = [0, *cuts.tolist(), len(ranks)]
            for k, rank in enumerate(heads):
                queue.push_many(rank, positions[bounds[k] : bounds[k + 1]])

        at = at[pair[at] >= 0]
        if len(at):
            push(pair[at], at)
        while (rank := queue.first()) >= 0:
            at = queue.pop_many(rank)
            at = at[pair[at] == rank]  # the rest is stale
            if not len(at):
                continue
            if len(at) > 1:
                at.sort()
                own = owner[at]
                fresh = np.concatenate(([True], own[1:] != own[:-1]))
                if not fresh.all():
                    queue.push_many(rank, at[~fresh])
                    at = at[fresh]
            right = after[at]
            far = after[right]
            token[at] = rank
            after[at] = far
            before[far] = at
            live[right] = False
            pair[right] = -1
            left = before[at]
            both = np.concatenate((at, left[left >= 0]))
            beyond = after[both]
            found = self.lookup(token[both], token[beyond])
            found[beyond == n] = -1
            pair[both] = found
            some = found >= 0
            if some.any():
                push(found[some], both[some])
        kept = np.flatnonzero(live[:n])
        ids = token[kept].tolist()
        ends = np.searchsorted(kept, last, "right").tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Per text: token count, digest of the decimal ids joined by commas, digest of the decoded bytes."""
        out, first = [], 0
        while first < len(texts):
            if self.held >= MEMO_HELD:
                self.start()
            memo, found, chars = self.memo, [], 0
            while first < len(texts) and chars < BUFFER_CHARS:
                found.append(self.pieces(texts[first]))
                chars += len(texts[first])
                first += 1
            self.learn(set().union(*found) - memo.keys())
            for pieces in found:
                parts = [memo[piece] for piece in pieces]
                ids = ",".join([part[0] for part in parts])
                out.append(
                    (
                        ids.count(",") + 1 if ids else 0,
                        hashlib.sha256(ids.encode()).hexdigest(),
                        hashlib.sha256(b"".join([part[1] for part in parts])).hexdigest(),
                    )
                )
            for piece in [piece for piece in memo if len(piece) > MEMO_BYTES]:
                del memo[piece]
        return out


_CODECS: dict[tuple[str, str], Codec] = {}


def forget() -> None:
    """Drop the memos that a task filled."""
    for own in _CODECS.values():
        own.start()


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    found = _CODECS.get((path, pattern))
    if found is None:
        found = _CODECS[path, pattern] = Codec(load_ranks(path), pattern)
    return found


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text: ``id_col`` and ``ids array<int>``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in sliced(batches):
            ids = [c.encode(text or "") for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    kept = docs.select(id_col, text_col)
    return kept.mapInArrow(released(run, forget), f"{id_col} {kept.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(ids: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of every id list: ``id_col`` and ``bytes binary``; a null list gives empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            raw = [c.decode(row or []) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], [id_col, "bytes"])

    kept = ids.select(id_col, ids_col)
    return kept.mapInArrow(released(run, forget), f"{id_col} {kept.schema[id_col].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass, keeping digests only (see SCHEMA)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in sliced(batches):
            rows = c.digests([text or "" for text in batch.column(1).to_pylist()])
            n, ids, raw = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    from pyspark.sql import functions as F

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(released(run, forget), SCHEMA)
