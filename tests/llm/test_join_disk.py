"""Disk of the joins: what a step shuffled or wrote for itself goes with it, and only what can link travels."""

import glob
import os
import random
import time

from stopwise.llm import ngram_join
from stopwise.session import discard, materialize, materialize_all


def shuffled(spark) -> set[str]:
    return set(glob.glob(f"{spark.conf.get('spark.local.dir')}/**/shuffle_*.data", recursive=True))


def test_a_written_frame_leaves_no_shuffle_and_can_be_deleted(spark):
    before = shuffled(spark)
    frames = [spark.range(n, n + 1000).repartition(3, "id").groupBy("id").count() for n in (0, 1000)]
    kept = materialize_all(frames, "numbers")
    one = materialize(frames[0], "one")
    until = time.time() + 20  # files go a moment later
    while shuffled(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled(spark) - before
    assert kept.count() == 2000 and kept.dtypes == frames[0].dtypes
    assert one.count() == 1000 and len(frames[0].collect()) == 1000
    folder = os.path.dirname(kept.inputFiles()[0]).removeprefix("file:").replace("///", "/")
    assert os.listdir(folder)
    discard(kept)
    assert not os.path.exists(folder) and one.count() == 1000


def passages(copies: int, edited: int) -> list[str]:
    """Texts of their own with one passage that all have, exact copies of the first, and near copies that don't all link."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(80)]
    out = [" ".join([word() for _ in range(200)] + passage) for _ in range(70)]
    base = out[0].split()
    for _ in range(edited):
        own = list(base)
        for _ in range(3):
            own[rng.randrange(200)] = word()
        out.append(" ".join(own))
    return out + [out[0]] * copies


def test_a_shared_passage_brings_no_documents_into_blocks(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(passages(0, 0))), "doc_id long, text string").repartition(4)
    seen, products = [], ngram_join._products
    monkeypatch.setattr(ngram_join, "_products", lambda groups, *a: seen.append(groups.count()) or products(groups, *a))
    found = {r.doc_id: r.component_id for r in ngram_join.component_ids(docs).collect()}
    assert found == {i: i for i in range(70)} and seen == [0]


def test_copies_send_no_fragments(spark, monkeypatch):
    texts = passages(40, 40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    seen, groups = [], ngram_join.fragment_groups
    monkeypatch.setattr(ngram_join, "fragment_groups", lambda docs, *a: seen.append(docs.count()) or groups(docs, *a))
    found = {r.doc_id: r.component_id for r in ngram_join.component_ids(docs).collect()}
    assert seen == [len(set(texts))]
    assert {found[i] for i in range(110, 150)} == {found[0]} == {0}
