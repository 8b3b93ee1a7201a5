"""N-gram join, embeddings, components, urls and archives against brute force."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest

from stopwise.llm import embeddings, graph, ngram_join, queries, urls, warc

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lowest(nodes, links):
    """Smallest reachable node of each node."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(400 + i, 401 + i) for i in range(40)]
    links += [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3), (3, None)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    plain = lowest({n for link in links for n in link if n is not None}, [x for x in links if None not in x])
    assert {n: found.get(n, n) for n in plain} == plain
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_keeps_components():
    rng = np.random.default_rng(1)
    for _ in range(20):
        m = rng.random((30, 30)) < 0.03
        m = (m | m.T) & ~np.eye(30, dtype=bool)
        ids = rng.permutation(1000)[:30].astype(np.int64)
        nodes = ids.tolist()
        links = [(nodes[i], nodes[j]) for i, j in zip(*np.nonzero(m))]
        assert lowest(nodes, graph.forest(m, ids, ids)) == lowest(nodes, links)


def shingle_set(text, k):
    words = WORDS.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def edited_texts(seed, groups=14, copies=9):
    """Near copies at every degree of change, exact copies, shared passages, odd and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(60)]
    out = []
    for g in range(groups):
        base = [word() for _ in range(rng.choice((4, 6, 9, 15, 30, 80, 200)))]
        for c in range(copies):
            own = list(base)
            for _ in range(int(len(own) * rng.choice((0, 0.01, 0.02, 0.04, 0.1)) + rng.random())):
                own[rng.randrange(len(own))] = word()
            if c % 4 == 3:
                own = own[: len(own) - rng.randint(0, 1 + len(own) // 10)]
            if g % 3 == 0 and c % 2:
                own += passage
            out.append(" ".join(own))
    return out + ["", None, " \n", "One", "one", "a b c", "a b c", "A  b\tc", "x" * 5000]


@pytest.mark.parametrize(("k", "num", "paired"), [(4, 85, 24), (5, 80, 24), (5, 80, 2)])
def test_ngram_join_against_brute_force(spark, monkeypatch, k, num, paired):
    monkeypatch.setattr(ngram_join, "PAIRED", paired)
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 500)
    texts = edited_texts(k + paired)
    rows = [(i, t, "a", "b", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, class string, n int").repartition(5)
    found = {r.doc_id: r for r in ngram_join.component_ids(docs, k, num, 100).collect()}
    sets = [shingle_set(t, k) for t in texts]
    links = [
        (i, j)
        for i in range(len(sets))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])
    ]
    assert {i: r.n_shingles for i, r in found.items()} == {i: len(s) for i, s in enumerate(sets)}
    assert {i: r.component_id for i, r in found.items()} == lowest(range(len(sets)), links)
    kept = {r.doc_id for r in ngram_join.keep_one(docs, k, num, 100).collect()}
    assert kept == {i for i, root in lowest(range(len(sets)), links).items() if i == root}


def test_ngram_join_repeated_rows_and_nulls(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "x y z x y z"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.component_ids(docs).collect()), key=str)
    assert found == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (None, 2, 1), (None, 2, None)]
    assert ngram_join.component_ids(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("cell", "block"), [(4096, 2048), (40, 25)])
def test_embeddings_against_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embeddings, "CELL", cell)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(60, 16))
    x = base[rng.integers(0, 60, 300)] + rng.normal(size=(300, 16)) * rng.choice([0, 0.1, 0.3], 300)[:, None]
    x = x.astype(np.float32)
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]
    odd = [None, [], [0.0] * 16, [1.0] * 15 + [float("nan")], [1.0] * 15 + [None], [1.0] * 15 + [float("inf")], [3.0, 4.0], [6.0, 8.0], [1e-30, 0.0], [1.0, 0.0]]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    found = {r.vec_id: r for r in embeddings.near_dedup(vectors).collect()}
    assert len(found) == len(rows)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    links = list(zip(*np.nonzero(linked))) + [(1006, 1007), (1008, 1009)]
    plain = lowest([r[0] for r in rows], links)
    assert {i: r.component_id for i, r in found.items()} == plain
    degree = {r[0]: 0 for r in rows} | {i: int(n) for i, n in enumerate(linked.sum(1))} | {1006: 1, 1007: 1, 1008: 1, 1009: 1}
    assert {i: r.n_links for i, r in found.items()} == degree
    assert all(r.kept == (i == r.component_id) for i, r in found.items())
    assert embeddings.near_dedup(vectors.limit(0)).count() == 0


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def plain_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fits = [(len(h + p), h + p, a) for h, p, a in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else (None, None)


def test_urls(spark):
    pages = [
        (1, "HTTP://A.Example.com/en/x?q=1", ""),
        (2, "https://www.example.com/en/1", None),
        (3, None, ""),
        (4, "no url", ""),
        (5, "http://a.com", ""),
        (6, "http://x.net/fr/1", '<link rel="canonical" href="http://other.org/a?utm_source=x#top">'),
        (7, "https://other.org/a", ""),
        (8, "http://third.org/1", '<meta http-equiv="refresh" content="0; url=https://other.org/a">'),
        (9, "http://fourth.org/1", "<link href='/2' rel=canonical>"),
        (10, "http://fourth.org/2", ""),
        (11, "http://y.net/es/1", '<link rel=canonical href="http://shop.com/a">'),
        (12, "http://fifth.org/x", '<link rel=canonical href="http://shop.com/a">'),
        (13, "http://shop.com/a", ""),
        (13, "http://shop.com/a", ""),
    ]
    table = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, host string")
    redirects = spark.createDataFrame([("http://fourth.org/2", "http://third.org/1")], "src string, dst string")
    found = urls.judge(table, RULES, redirects).collect()
    assert sorted(r.page_id for r in found) == sorted(p[0] for p in pages)
    by_id = {r.page_id: r for r in found}
    for page, url, _ in pages:
        host, path, (rule, action) = plain_rule(url)
        assert (by_id[page].host, by_id[page].path, by_id[page].rule) == (host, path, rule)
        assert action is None or by_id[page].verdict == action
    # blocks reach aliases over any number of edges; an explicit allow in a component wins
    assert [by_id[i].verdict for i in (6, 7, 8, 9, 10)] == ["block"] * 5
    assert [by_id[i].verdict for i in (11, 12, 13)] == ["block", "allow", "allow"]
    assert [by_id[i].verdict for i in (3, 4)] == ["allow"] * 2
    assert urls.judge(table.limit(0), RULES).count() == 0


def test_rules_on_all_pages(spark):
    path = "/root/testdata/sf0.01"
    given = {r.page_id: r.url for r in queries.table(spark, path, "pages").select("page_id", "url").collect()}
    found = queries.op6_url_filter(spark, path).collect()
    assert len(found) == len(given)
    for r in found:
        host, url_path, (rule, action) = plain_rule(given[r.page_id])
        assert (r.host, r.path, r.rule) == (host, url_path, rule)
        assert action is None or r.verdict == action


def test_loser_tree():
    rng = random.Random(9)
    for k in (0, 1, 2, 3, 7, 8):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(12))) for _ in range(k)]
        merged = list(warc.LoserTree([iter([(v,) for v in run]) for run in runs], lambda row: row))
        assert merged == sorted((v,) for run in runs for v in run)


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 3000)
    pages = [
        (5, "http://b.com/x?y=1", "same"),
        (3, "http://a.b.com/x", "same"),
        (9, "http://b.com/x", "same"),
        (1, None, None),
        (2, "no url", ""),
        (4, "http://z/é\r\n?q", "é\r\n\r\nWARC/1.1\r\n\r\n"),
        (6, "HTTP://B.com/x#f", "x" * 5000),
        (None, "http://n.net/", "alone"),
    ]
    table = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, position int").repartition(3)
    rows = warc.capture_histories(table).collect()
    order = [(r.url_key, r.captured_at, r.position) for r in rows]
    assert order == sorted(order) and len(rows) == len(pages)
    first = {}
    for page, _, html in pages:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    by_id = {r.page_id: r for r in rows}
    for page, _, html in pages:
        raw = (html or "").encode()
        r = by_id[page]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        expected = None if page is None or first[html or ""] == page else first[html or ""]
        assert (r.record_type, r.refers_to) == ("response" if expected is None else "revisit", expected)
    assert {r.record_type for r in warc.capture_histories(table, min_bytes=5).collect()} == {"response"}
    assert warc.capture_histories(table.limit(0)).count() == 0


def test_warc_keeps_every_payload_of_a_repeated_id(spark):
    pages = [(1, "http://a/1", "first"), (2, "http://a/2", "first"), (2, "http://a/2", "unique"), (2, "http://a/2", "first"), (3, "http://a/3", "first"), (1, "http://a/1", "first")]
    rows = warc.capture_histories(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)).collect()
    digest = lambda text: base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
    expected = [(page, digest(html), *(("revisit", 1) if html == "first" and page > 1 else ("response", None))) for page, _, html in pages]
    assert sorted(((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == sorted(expected, key=str)


def test_embeddings_with_repeated_and_missing_ids(spark):
    a, near, far, alone = [1.0, 0.0, 0.0], [0.99, 0.05, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(7, a), (7, far), (3, far), (None, near), (9, near), (None, alone), (None, alone), (5, None), (None, None), (7, a)]
    found = embeddings.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in found), key=str)
    # two rows of 7 and both rows near them link; its third row links with 3 only
    expected = [(7, 3, 7, True), (7, 3, 7, True), (9, 3, 7, False), (None, 3, 7, False), (7, 1, 3, False), (3, 1, 3, True)]
    expected += [(None, 1, None, False), (None, 1, None, False), (5, 0, 5, True), (None, 0, None, False)]
    assert got == sorted(expected, key=str)
