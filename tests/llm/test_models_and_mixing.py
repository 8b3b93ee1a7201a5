"""Toxicity, secrets, mixing and the pipeline: held-out accuracy, planted cases and plain versions."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from stopwise.llm import mixing, queries, secrets, toxicity

BAD = ("vexol", "grumphy", "zanking")


def labelled(n, seed=1):
    """Invented prose; toxic texts hold an inflected form of a bad stem."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    out = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(3, 80))]
        toxic = int(i % 4 == 0)
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(BAD) + rng.choice(("", "s", "ers", "ish", "!!"))
        out.append((" ".join(text).encode(), toxic, rng.choice(("en", "de", None))))
    return out


def test_toxicity_on_held_out_texts():
    model = toxicity.fit(labelled(800))
    rest = labelled(300, seed=1)[:0] + labelled(1100)[800:]
    scores = model.scores([t for t, _, _ in rest])
    y = np.array([label for _, label, _ in rest])
    order = scores.argsort()
    rank = np.empty(len(y))
    rank[order] = np.arange(len(y))
    auc = (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())
    assert auc > 0.97
    assert ((scores >= 0.7) == (y == 1)).mean() > 0.93
    assert set(model.thresholds) >= {"", "en", "de"}


def test_toxicity_scores_whole_texts():
    model = toxicity.fit(labelled(800))
    filler = b"alone nest rain " * 60_000
    clean, toxic = model.scores([filler, filler + b"vexolers"])
    assert toxic - clean > 0.5
    assert (model.scores([b"", b"", b"a"]) >= 0).all() and model.scores([b""])[0] == model.scores([b" \n"])[0]
    assert model.scores([]).shape == (0,)


@pytest.mark.parametrize("sample", [[], [(b"one", 1, "en")], [(b"one", 0, None)] * 3])
def test_toxicity_without_both_kinds(sample):
    scores = toxicity.fit(sample).scores([b"any text", b""])
    assert scores[0] == scores[1] and 0 < scores[0] < 1


def test_toxicity_frames(spark):
    rows = [(i, t.decode(), lang, "src0", len(t), 0.5) for i, (t, _, lang) in enumerate(labelled(400))] + [(900, None, None, None, None, None), (901, "", "xx", "s", 0, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, score double")
    labels = spark.createDataFrame([(i, y) for i, (_, y, _) in enumerate(labelled(400))] + [(None, 1), (5, None), (7777, 1)], "doc_id long, toxic int")
    sample, share = toxicity.training_sample(docs, labels, rows=300)
    assert len(sample) == 300 and sum(y for _, y, _ in sample) == 100 and share == pytest.approx(101 / 401)
    model = toxicity.fit(sample, share)
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == len(rows)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in scored if not r.rejected}
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.training_sample(docs, labels.limit(0)) == ([], None)


SECRETS = ('token = "{}"', "password: {}", "api_key={}")


def test_secrets(spark):
    rng = random.Random(4)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    words = "the rain in spain stays mainly near a plain old town by that river".split()
    prose = lambda: " ".join(rng.choice(words) for _ in range(40))
    rows, planted, clean = [], {}, {}
    for i in range(240):
        kind = i % 4
        value = hexes(40) if kind < 2 else "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)) if kind == 2 else str(rng.randrange(10**15, 10**16))
        text = prose() + " " + (rng.choice(SECRETS).format(value) if kind < 2 else value if kind == 2 else "card " + value) + " " + prose()
        (planted if kind < 3 else clean)[i] = value
        rows.append((i, text, "en", f"src{i % 3}", len(text), 9))
    rows += [(500, None, None, None, None, None), (501, "", "en", "s", 0, 1), (502, "commit " + hexes(40) + " merged", "en", "s", 54, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, start int").repartition(3)
    scanner = secrets.train(docs)
    texts = {r[0]: r[1] for r in rows}
    found = secrets.scan(docs, scanner).collect()
    hits = {(r.doc_id, texts[r.doc_id][r.start : r.end]) for r in found if r.secret}
    assert len(set(planted.items()) - hits) <= 3
    assert not {doc for doc, _ in hits} & ({500, 501, 502} | set(clean))
    cleaned = {r.doc_id: r for r in secrets.redact(docs, scanner).collect()}
    assert len(cleaned) == len(rows) and secrets.redact(docs, scanner).columns == docs.columns
    for doc, value in hits:
        assert value not in cleaned[doc].text and secrets.redact.__defaults__[1] in cleaned[doc].text
    for doc in clean:
        assert cleaned[doc].text == texts[doc]
    assert all(r.n_chars == len(r.text) for r in cleaned.values() if r.text is not None and r.doc_id != 502)
    # the trees that redact() walks are the forest that scan() applies
    trees = secrets.plain_trees(scanner.forest)
    for r in found[:50]:
        text = texts[r.doc_id]
        row = secrets.features(text, r.start, r.end, r.kind, f"src{r.doc_id % 3}" if r.doc_id < 500 else "s", scanner.language)
        assert secrets.probability(trees, row) == pytest.approx(r.score)
    assert secrets.scan(docs.limit(0), scanner).count() == 0
    assert secrets.train(docs.limit(0)).forest.getNumTrees > 0


def fill(children, budget):
    """Shares by weight of what is left, until nobody is over its supply."""
    got, left = {}, dict(children)
    while left:
        mass = sum(w for _, w in left.values())
        full = {c: s for c, (s, w) in left.items() if budget * w / mass >= s}
        if not full:
            return got | {c: budget * w / mass for c, (s, w) in left.items()}
        got |= full
        budget -= sum(full.values())
        left = {c: v for c, v in left.items() if c not in full}
    return got


@pytest.mark.parametrize(("share", "epochs"), [(0.3, 1), (0.9, 1), (1.0, 1), (1.6, 3), (5.0, 2)])
def test_mixing(spark, share, epochs):
    rng = random.Random(6)
    rows = [
        (i, " ".join("w" for _ in range(rng.randint(0, 60))), rng.choice(("en", "en", "en", "de", None)), f"src{rng.choice((0, 0, 0, 0, 1, 2, 5, 6, 7))}", 1, "x", 2)
        for i in range(900)
    ] + [(2000, None, "en", "src1", 0, "x", 2), (5, "w w", "fr", "src9", 1, "x", 2), (5, "w w", "fr", "src9", 1, "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, domain string, budget int").repartition(4)
    weights = {"domain": {"web": 0.5, "books": 0.2, "code": 0.3}, "lang": {"en": 0.6, "de": 0.4, "fr": 0.1}}
    domain = queries.domain_of(docs["source"])
    chosen, plan = mixing.choose(docs, share, weights, epochs, 7, domain)
    leaves = {}
    name = lambda source: queries.DOMAINS[int(source[3:]) % 4]
    for _, text, lang, source, *_ in rows:
        key = name(source), lang or "\x00", source
        leaves[key] = leaves.get(key, 0) + len((text or "").split())
    total = sum(leaves.values()) * share
    supply = lambda *prefix: sum(n for key, n in leaves.items() if key[: len(prefix)] == prefix) * epochs
    budget = {}
    for d, b in fill({d: (supply(d), weights["domain"].get(d, 1.0)) for d in {k[0] for k in leaves}}, total).items():
        for g, c in fill({g: (supply(d, g), weights["lang"].get(g, 1.0)) for g in {k[1] for k in leaves if k[0] == d}}, b).items():
            own = {k[2]: (supply(d, g, k[2]), 1.0) for k in leaves if k[:2] == (d, g)}
            budget |= {(d, g, s): x for s, x in fill(own, c).items()}
    got = {(r.domain, r.lang_key, r.source_key): r.budget for r in plan.collect()}
    assert got.keys() == budget.keys()
    for key, value in budget.items():
        assert got[key] == pytest.approx(value, abs=1e-6)
    picked = chosen.collect()
    assert chosen.columns == [*docs.columns, "_epoch"]
    taken = {}
    longest = {}
    for r in picked:
        key = name(r.source), r.lang or "\x00", r.source
        n = len((r.text or "").split())
        taken[key] = taken.get(key, 0) + n
    for _, text, lang, source, *_ in rows:
        key = name(source), lang or "\x00", source
        longest[key] = max(longest.get(key, 0), 2 * len((text or "").split()))
    for key, value in budget.items():
        # a prefix ends with the document that reaches the budget
        assert value - 0.51 <= taken.get(key, 0) < value + longest[key] + 1e-6
    assert max((r._epoch for r in picked), default=0) < epochs
    assert sorted(map(str, picked)) == sorted(map(str, mixing.mix(docs, share, weights, epochs, 7, domain).collect()))


def test_mixing_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert mixing.mix(docs).count() == 0


def test_pipeline_stage_by_stage(spark):
    """Every stage on its own input, over odd rows; the whole run over the test tables."""
    path = "/root/testdata/sf0.001"
    docs = queries.table(spark, path, "documents")
    names = docs.columns
    odd = spark.createDataFrame(
        [(900001, None, None, None, None), (900002, "", "en", "src0", 0), (900003, "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" here", "en", "src1", 55), (None, "a b", "de", "src2", 3)],
        docs.schema,
    )
    first = docs.orderBy("doc_id").limit(1)
    current = docs.union(odd).union(first)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        following = stage(spark, current, path)
        assert following.columns == names, name
        kept = following.collect()
        assert kept, name
        if name == "n-gram Jaccard join":
            texts = [r.text for r in kept if r.text and len(re.findall(r"\S+", r.text)) >= 5]
            assert len(texts) == len(set(texts))
        if name == "secret scans":
            assert len(kept) == current.count()
            assert not any("24be64439e3e49cf46b2d7c90f3602a3d0b907ff" in (r.text or "") for r in kept)
        current = spark.createDataFrame(kept, docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, current, path)
    assert last.count() == current.count()
    assert corpus_pipeline.STAGES[0][1](spark, docs.limit(0), path).count() == 0


def test_mix_keeps_a_column_called_like_the_epoch(spark):
    docs = spark.createDataFrame([(i, "one two three", "en", "src1", f"own {i}", 1) for i in range(6)], "doc_id long, text string, lang string, source string, _epoch string, row int")
    chosen = mixing.mix(docs, share=2.0, max_epochs=2)
    assert chosen.columns == [*docs.columns, "__epoch"]
    assert sorted((r["doc_id"], r["_epoch"], r["__epoch"]) for r in chosen.collect()) == [(i, f"own {i}", e) for i in range(6) for e in (0, 1)]
    plain = mixing.mix(docs, share=0.5, epoch_col=None)
    assert plain.columns == docs.columns and 0 < plain.count() <= 6
