"""What one worker allocates at once while it hashes, counts or merges a slice of text."""

import tracemalloc

import numpy as np

from stopwise.llm import bpe, toxicity
from stopwise.llm.hashing import LETTERS, word_hashes


def peak(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_hashing_and_counting_a_slice_stays_small():
    texts = [b"some words of a text that repeats " * 60] * 1000
    assert peak(lambda: [None for _ in word_hashes(texts, LETTERS, toxicity.PREFIXES)]) < 60
    words, counts = toxicity._encode(texts)
    assert words.dtype.itemsize == 4
    slots, seen = toxicity._texts_per_slot(words, counts)
    assert (seen == 1000).all() and (slots == np.unique(words)).all()


def test_codec_is_built_in_little_memory():
    ranks = {bytes([b]): b for b in range(256)}
    for a in range(97, 123):
        for b in range(256):
            for token in (bytes([a, b]), bytes([a, b, a, b])):
                ranks.setdefault(token, len(ranks))
    codec = bpe.Codec(ranks, r"\S+|\s+")
    assert (np.diff(codec.pair_keys) > 0).all() and codec.pair_ranks.dtype == np.int32
    pieces = [b"abab", b"zzz", b"q"]
    assert codec.merge_many(pieces) == [codec.merge(piece) for piece in pieces]
