"""BPE with word ends against the tokenizers library."""

import hashlib
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from stopwise.llm import word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "\n\n x\ty", "aaaa aaaa", "a" * 3000, "ab" * 1500, "中文 日本語 한국어 😀\x00", "<|endoftext|>A<|startoftext|> x<|endoftext|>",
    "Don't   'S x'lls\r\n", "ΑΣ ΣΑΣ İstanbul ẞ", "</w> a</w> <|endoftext", "é É Å", "a\x1c b\x85c　d", "Ᲊ \U00010d50x Ɤ", "x1y22z",
    "same text", "same text", "nạ̈ive ḍ̇",
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return word_bpe.Codec(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    digest = [hashlib.sha256(s.encode()).hexdigest() for s in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
    return len(ids), *digest


def random_texts(n, letters, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_equals_the_library(library, codec):
    texts = [t or "" for t in ODD] + random_texts(600, "aabcdeinorst  \n.,'ABéñ中😀0123<|>/w", 1) + random_texts(200, "abn ", 2)
    rng = random.Random(3)
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0xD000), rng.randrange(0xE000, 0x20000)])) for _ in range(60)) for _ in range(400)]
    assert codec.digests(texts) == [expected(library, t) for t in texts]
    for text in texts[:100]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids and codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_letter_is_normalised_and_cut_like_the_library(codec):
    codec.by_library("x")
    normalizer, split = codec.library
    plain = [c for c in map(chr, range(0x20000)) if not 0xD800 <= ord(c) < 0xE000 and not word_bpe.CHANGING.search(c)]
    for c in plain:
        text = f"A{c}!{c}{c}1b"
        assert codec.plain(text) == [p for p, _ in split.pre_tokenize_str(normalizer.normalize_str(text))], hex(ord(c))


def test_traversal_equals_merging_each_word(codec):
    """Distinct words through one trie against repeated lowest-rank merges of each alone."""
    merges = codec.merges
    number = {token: i for i, token in enumerate(merges.text)}

    def merge(word):
        ids = [number[c] for c in word[:-1]] + [number[word[-1] + word_bpe.SUFFIX]]
        while True:
            ranks = [(merges.merge.get(pair, word_bpe.NEVER), i) for i, pair in enumerate(zip(ids, ids[1:]))]
            rank, i = min(ranks, default=(word_bpe.NEVER, 0))
            if rank == word_bpe.NEVER:
                return ids
            ids[i : i + 2] = [merges.rank.index(rank)]

    merges.rank = list(merges.rank)
    words = {"".join(w.split()) for w in random_texts(150, "aeinorstghl", 4)} - {""}
    words |= {w[:n] for w in list(words)[:20] for n in range(1, len(w))}
    assert dict(merges.traverse(words)) == {word: merge(word) for word in words}


def test_long_texts_are_read_in_windows(library, monkeypatch):
    monkeypatch.setattr(word_bpe, "BUFFER_CHARS", 50)
    codec = word_bpe.Codec(PATH)
    texts = [" ".join(random_texts(40, "abcde \n'é1.", 5)), "x" * 400, "y " * 200, "a" * 49 + "<|endoftext|> é" * 9]
    assert codec.digests(texts) == [expected(library, t) for t in texts]


def test_query_shape(spark, library):
    rows = [(i, t, "en", 1, "k") for i, t in enumerate(ODD)] + [(None, "no id", "en", 1, "k"), (3, "again", "en", 1, "k"), (3, "again", "en", 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens long, ids string").repartition(3)
    found = [tuple(r) for r in word_bpe.round_trip(docs, PATH).collect()]
    assert sorted(found, key=repr) == sorted([(r[0], *expected(library, r[1])) for r in rows], key=repr)
    assert word_bpe.round_trip(docs.where("false"), PATH).count() == 0
    encoded = word_bpe.encode(docs.where("doc_id < 12 AND doc_id <> 3"), PATH)
    decoded = {r["doc_id"]: r["text"] for r in word_bpe.decode(encoded, PATH).collect()}
    assert decoded == {i: library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, t in enumerate(ODD[:12]) if i != 3}
