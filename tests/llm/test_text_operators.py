"""Byte-level BPE, token counts, hashing and fingerprints against libraries and plain versions."""

import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F

from stopwise.llm import bpe, fingerprints, hashing, queries, tokens

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n\n x\ty", "aaaa aaaa", "a" * 3000, "ab" * 1500, "é" * 99, "中文 日本語 한국어 😀\x00", "<|endoftext|> <s>x</s>",
    "Don't   stop\r\n", " ".join("x" * n for n in range(60)), "▁▁ a▁b", "same text", "same text",
]


def random_texts(n, alphabet="aabcdeinorst  \n.,'ABéñ中😀0123456789", seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def frame(spark, texts, partitions=3):
    """Documents with clashing extra columns."""
    rows = [(i, t, "en", "src0", 0, "k", 1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, n double").repartition(partitions)


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_rank_queue_finds_the_smallest_rank():
    queue, rng = bpe.RankQueue(), random.Random(2)
    ranks = [rng.randrange(200_000) for _ in range(500)]
    for position, rank in enumerate(ranks):
        queue.push(rank, position)
    taken = []
    while (rank := queue.first()) >= 0:
        taken.append((rank, queue.pop(rank)))
    assert taken == sorted((rank, position) for position, rank in enumerate(ranks))


def test_encode_matches_the_library(encoding):
    codec = bpe.Codec(bpe.load_ranks(RANKS), public_tokenizers.PATTERN)
    texts = [t or "" for t in ODD] + random_texts(300) + random_texts(50, "ab ")
    for text in texts:
        assert codec.encode(text) == encoding.encode_ordinary(text)
        assert codec.decode(codec.encode(text)) == text.encode()
    for text, got in zip(texts, codec.digests(texts)):
        ids = encoding.encode_ordinary(text)
        plain = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got == (len(ids), plain, hashlib.sha256(text.encode()).hexdigest())


def test_round_trip_frame(spark, encoding):
    docs = frame(spark, ODD)
    found = {r.doc_id: r for r in bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert len(found) == len(ODD)
    for i, text in enumerate(ODD):
        assert found[i].n_tokens == len(encoding.encode_ordinary(text or ""))
        assert found[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    ids = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(ids, RANKS, public_tokenizers.PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(ODD)}
    assert bpe.round_trip(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_token_counts_match_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    transducer = tokens.Transducer(PIECES)
    for text in [t or "" for t in ODD] + random_texts(1500):
        assert transducer.count(text) == len(library.encode(text)), text


@pytest.mark.parametrize("size", [1, 3, 17])
def test_state_maps_compose(size):
    transducer = tokens.Transducer(PIECES)
    for text in [t for t in ODD if t] + random_texts(150, seed=4):
        parts = [text[i : i + size] for i in range(0, len(text), size)]
        if parts:
            maps = [transducer.state_map(tokens.escape(p) if i == 0 else p.replace(" ", tokens.SPACE)) for i, p in enumerate(parts)]
            assert transducer.scan(maps) == transducer.count(text)


def test_token_count_frame(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = frame(spark, ODD)
    for chunk in (1 << 16, 20):
        found = {r.doc_id: r for r in tokens.count_tokens(docs, PIECES, chunk).collect()}
        assert {i: (r.n_bytes, r.n_tokens) for i, r in found.items()} == {
            i: (len((t or "").encode()), len(library.encode(t or ""))) for i, t in enumerate(ODD)
        }
    assert tokens.count_tokens(docs.limit(0), PIECES).count() == 0


def test_hashes_of_words_do_not_depend_on_the_buffer(monkeypatch):
    texts = [(t or "").encode() for t in ODD] + [b"word " * 5000, b"x" * 9000 + b" y"]
    whole = [(c.tolist(), w.tolist()) for _, w, c in hashing.word_hashes(texts)]
    monkeypatch.setattr(hashing, "BUFFER", 700)
    parts = [(c.tolist(), w.tolist()) for _, w, c in hashing.word_hashes(texts)]
    flat = lambda found: ([c for cs, _ in found for c in cs], [w for _, ws in found for w in ws])
    assert flat(whole) == flat(parts)
    counts = flat(whole)[0]
    assert counts == [len(t.lower().split()) for t in texts]


def edited_plain(texts, i):
    text, following = texts[i] or "", texts[(i + 1) % len(texts)] or ""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def test_edited_fingerprints(spark):
    texts = ODD + random_texts(40) + ["a b c d e f g h"] * 3
    rows = {r.doc_id: r for r in fingerprints.edited_fingerprints(frame(spark, texts)).collect()}
    assert sorted(rows) == list(range(len(texts)))
    for i, text in enumerate(texts):
        edited = edited_plain(texts, i)
        assert rows[i].n_chars == len(text or "")
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        plain = fingerprints.as_text(fingerprints.packed(fingerprints.signatures([edited.encode(), (text or "").encode()])))
        assert [rows[i].edited_fingerprint, rows[i].fingerprint] == plain
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
    assert rows[len(texts) - 3].near_next == 1
    assert fingerprints.edited_fingerprints(frame(spark, ODD).limit(0)).count() == 0
    one = fingerprints.edited_fingerprints(frame(spark, ["only one text here now ok"])).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_minhash_estimates_jaccard():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(4000)]
    for share in (0.2, 0.5, 0.9):
        a = rng.choice(words, 400).tolist()
        n = int(400 * share)
        b = a[:n] + rng.choice(words, 400 - n).tolist()
        sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b)]
        jaccard = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        low = fingerprints.packed(fingerprints.signatures([" ".join(a).encode(), " ".join(b).encode()]))
        assert abs((low[0] == low[1]).mean() - jaccard) < 0.2


def test_near_pairs_verify_jaccard(spark):
    base = " ".join(f"w{i}" for i in range(200))
    texts = [base, base, base + " tail", base.replace("w100 ", "x "), "other words " * 60, None, ""]
    found = {(r.a, r.b): r.jaccard for r in fingerprints.near_pairs(frame(spark, texts)).collect()}
    assert found[0, 1] == 1.0
    assert found[0, 2] == pytest.approx(196 / 197)
    assert found[0, 3] == pytest.approx(191 / 201)
    assert not {i for pair in found for i in pair} & {4, 5, 6}


@pytest.mark.parametrize("paired", [24, 3])
def test_near_groups_of_a_template_equal_brute_force(spark, monkeypatch, paired):
    """Near and not so near texts of one template in shared buckets; buckets compared in pairs, and in blocks."""
    monkeypatch.setattr(fingerprints.ngram_join, "PAIRED", paired)
    monkeypatch.setattr(fingerprints.ngram_join, "BLOCK_DOCS", 16)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = [None, "", "one two"]
    for _ in range(90):
        words = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(60)] = f"x{rng.randrange(40)}"
        texts.append(" ".join(words))
    sets = [set(zip(*[(t or "").split()[i:] for i in range(5)])) or ({tuple((t or "").split())} if (t or "").split() else set()) for t in texts]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root = list(range(len(texts)))
    for _ in texts:
        for i, j in linked:
            root[i] = root[j] = min(root[i], root[j])
    got = {r.doc_id: r.group_id for r in fingerprints.near_groups(frame(spark, texts)).collect()}
    assert got == dict(enumerate(root))
    pairs = {(r.a, r.b): r.jaccard for r in fingerprints.near_pairs(frame(spark, texts)).collect()}
    for (a, b), jaccard in pairs.items():
        if jaccard is None:  # tied by blocks: of one component
            assert root[a] == root[b]
        else:
            assert (b, a) in linked and jaccard == pytest.approx(len(sets[a] & sets[b]) / len(sets[a] | sets[b]))
    assert fingerprints.near_groups(frame(spark, texts).where("false")).count() == 0


def minhash(text):
    """Signature of a text, one shingle and permutation at a time."""
    words = [w.lower() for w in (text or "").encode().split()]
    grams = [words[i : i + 5] for i in range(max(1, len(words) - 4))] if words else []
    mask = (1 << 64) - 1
    seeds = [int(v) for v in fingerprints._seeds]
    hashed = [int(next(hashing.word_hashes([w]))[1][0]) for w in words]
    values = []
    for i, gram in enumerate(grams):
        total = 0
        for j in range(5):
            total = int(hashing.mix64(np.array([(total + (hashed[i + j] if j < len(gram) else 0) + j + 1) & mask], np.uint64))[0])
        values.append(total)
    n = fingerprints.PERMUTATIONS
    minima = [min(((v * (seeds[p] | 1)) + seeds[n + p]) & mask for v in values) if values else mask for p in range(n)]
    return [0xFFFF if m == mask else int(hashing.mix64(np.array([m], np.uint64))[0]) >> 48 for m in minima]


def test_likeness_of_edited_and_following_texts(spark):
    texts = ["a b c d e f g h i j", "a b c d e f g h i k", None, "é " * 30, "A B C D E F G H I J", "x"]
    rows = {r.doc_id: r for r in fingerprints.edited_fingerprints(frame(spark, texts)).collect()}
    like = lambda a, b: float(a == b) if not a or not b else sum(x == y for x, y in zip(minhash(a), minhash(b))) / 64
    for i, text in enumerate(texts):
        text, following = text or "", texts[(i + 1) % len(texts)] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert rows[i].fingerprint == "".join(f"{v:04x}" for v in minhash(text))
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        blank = lambda t: t if t.split() else ""
        assert rows[i].near_edited == pytest.approx(like(blank(text), blank(edited)))
        assert rows[i].near_next == pytest.approx(like(blank(text), blank(following)))


def test_query_over_test_tables(spark):
    path = "/root/testdata/sf0.001"
    n = queries.table(spark, path, "documents").count()
    assert queries.op10_byte_bpe(spark, path).count() == n
    counted = queries.op5_token_counts(spark, path)
    assert counted.where(F.col("over_limit") != (F.col("n_tokens") > 4096)).count() == 0 and counted.count() == n
    assert queries.op3_fingerprints(spark, path).count() == n
