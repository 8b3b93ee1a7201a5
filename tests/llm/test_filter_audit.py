"""The filter audit against a document-by-document walk through all orders."""

import re
from collections import Counter
from itertools import permutations
from math import factorial

import pytest

from stopwise.llm import filter_audit

PROSE = " ".join(f"w{i}" for i in range(120))
TEXTS = [
    None, "", " \n\t", PROSE, PROSE, PROSE, PROSE + " $", "A " * 120, "a " * 120, "SHOUT " * 3, "\x0b".join(f"v{i}" for i in range(100)),
    "\n".join(f"v{i}" for i in range(99)), "é\x00 #", "", "x|y", PROSE.upper(), " " + PROSE, "w\x1cv " * 130, "zz " * 200_000,
]


def failures(rows):
    """Masks by the rules' wording."""
    out = []
    for doc, text, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        mask = set()
        if len(words) < 100:
            mask.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            mask.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text):
            mask.add("C")
        if set(text) & set("#$%&*|"):
            mask.add("D")
        if doc is not None and any(o is not None and o < doc and (t or "") == text for o, t, *_ in rows):
            mask.add("E")
        out.append(mask)
    return out


def plain(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    masks, result, shapley = failures(rows), {}, Counter()
    for part in {lang or "" for _, _, lang in rows}:
        own = [(m, d in good, d in toxic) for m, (d, _, lang) in zip(masks, rows) if (lang or "") == part]
        for order in map("".join, permutations("ABCDE")):
            alive = own
            for step, letter in enumerate(order, 1):
                gone = [r for r in alive if letter in r[0]]
                alive = [r for r in alive if letter not in r[0]]
                fails = [r for r in own if letter in r[0]]
                result[part, order, step] = [
                    len(alive), len(gone), len(fails) - len(gone), sum(r[0] == {letter} for r in own), sum(r[1] for r in gone), sum(r[2] for r in gone)
                ]
                shapley[part, letter] += len(gone)
    return {key: (*row, shapley[key[0], key[1][key[2] - 1]]) for key, row in result.items()}


def run(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "s", 0, 1, 2) for r in rows], "doc_id long, text string, lang string, source string, mask int, part int, rows long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(docs.repartition(3), marks).collect()
    keyed = {tuple(r)[:3]: tuple(r)[3:] for r in found}
    assert len(keyed) == len(found)
    return keyed


def test_all_orders_with_odd_rows(spark):
    langs = ["en", None, "", "de"]
    rows = [(i * 7 % 40, text, langs[i % 4]) for i, text in enumerate(TEXTS)]
    rows += [(None, PROSE, "en"), (None, None, None), (5, PROSE, "fr"), (5, PROSE, "fr"), (5, "other", "en"), rows[3]]
    labels = [(d, q, t) for d, q, t in zip([*range(0, 40, 3), 7, 7, 99, None], [1, 0, None, 1] * 9, [0, 1, 1, None] * 9)]
    assert run(spark, rows, labels) == plain(rows, labels)


def test_empty_tables(spark):
    assert run(spark, [], [(1, 1, 1)]) == {}
    found = run(spark, [(1, "x", None)], [])
    assert len(found) == 600 and found["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_intervals_cover_every_order_once(n):
    letters = "ABCDE"[:n]
    orders = list(permutations(range(n)))
    for mask in range(1, 1 << n):
        steps = [0] * factorial(n)
        for own, step, start, stop in filter_audit.intervals(n):
            if own == mask:
                for rank in range(start, stop):
                    assert not steps[rank]
                    steps[rank] = step
        assert steps == [next(s for s, f in enumerate(order, 1) if mask >> f & 1) for order in orders], letters
