"""Vectorised word and shingle hashes of whole texts.

Texts are processed in joined buffers of at most ``BUFFER`` bytes (a longer text is cut at word
ends), so memory doesn't grow with the length of a text. All hashes are 64 bits and the same in
every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Each byte of a buffer takes some 50 bytes of a worker while it is hashed.
BUFFER = 400_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> _U(31))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def byte_class(separators: bytes) -> np.ndarray:
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    return inside


#: ASCII white space ends a word.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
BY_SPACE = byte_class(SPACE)
#: Letters and everything beyond ASCII are words, the rest separates.
LETTERS = np.array([bytes([b]).isalpha() or b >= 128 for b in range(256)])
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_VALUES = mix64(_FOLD.astype(np.uint64) + _U(1)) | _U(1)
_powers = np.cumprod(np.full(64, FACTOR | _U(1), np.uint64))


def _power_table(n: int) -> np.ndarray:
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate((_powers, _powers * _powers[-1]))
    return _powers


def _hash_buffer(data: np.ndarray, inside: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word; A-Z count as a-z. With prefixes, rows of the word's hash and those of its first bytes."""
    at = np.flatnonzero(inside[data])
    if not len(at):
        return np.empty((0, 1 + len(prefixes)) if prefixes else 0, np.uint64), np.empty(0, np.int64)
    head = np.concatenate(([True], np.diff(at) > 1))
    first = np.flatnonzero(head)
    length = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, length)
    terms = _VALUES[data[at]] * _power_table(int(length.max()))[place]
    words = mix64(np.add.reduceat(terms, first))
    if prefixes:
        parts = [mix64(np.add.reduceat(np.where(place < p, terms, _U(0)), first) + _U(p)) for p in prefixes]
        words = np.stack([words, *parts], 1)
    return words, at[first]


def _pieces(text: bytes, inside: np.ndarray) -> Iterator[bytes]:
    """A long text in parts that end between words."""
    first = 0
    while len(text) - first > BUFFER:
        window = np.frombuffer(text, np.uint8, BUFFER, first)
        gaps = np.flatnonzero(~inside[window])
        last = first + int(gaps[-1]) + 1 if len(gaps) else None
        if last is None:  # one word of more than the buffer's length
            rest = np.frombuffer(text, np.uint8, offset=first)
            gap = np.flatnonzero(~inside[rest])
            last = first + int(gap[0]) + 1 if len(gap) else len(text)
        yield text[first:last]
        first = last
    yield text[first:]


def word_hashes(texts: list[bytes], inside: np.ndarray = BY_SPACE, prefixes: tuple[int, ...] = ()) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, word hashes, words per text) for runs of texts, in order and each text whole."""
    first = 0
    while first < len(texts):
        if len(texts[first]) > BUFFER:
            words = np.concatenate([_hash_buffer(np.frombuffer(p, np.uint8), inside, prefixes)[0] for p in _pieces(texts[first], inside)])
            yield first, words, np.array([len(words)])
            first += 1
            continue
        last, size = first, 0
        while last < len(texts) and size + len(texts[last]) <= BUFFER:
            size += len(texts[last]) + 1
            last += 1
        own = texts[first:last]
        starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in own])))
        words, at = _hash_buffer(np.frombuffer(b"\n".join(own) + b"\n", np.uint8), inside, prefixes)
        yield first, words, np.diff(np.searchsorted(at, starts))
        first = last


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles and shingles per text; fewer than k words make one shingle, none make none."""
    ends = np.cumsum(counts)
    sizes = np.where(counts == 0, 0, np.maximum(counts - k + 1, 1))
    starts = np.repeat(ends - counts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    limit = np.repeat(ends, sizes)
    padded = np.append(words, np.zeros(k, np.uint64))
    total = np.zeros(len(starts), np.uint64)
    for j in range(k):
        at = starts + j
        total = mix64(total + np.where(at < limit, padded[at], _U(0)) + _U(j + 1))
    return total, sizes


def column_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return [b"" if value is None else value for value in column.cast(pa.binary()).to_pylist()]
