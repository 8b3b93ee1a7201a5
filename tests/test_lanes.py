"""Replicate lanes against a loop over replicates, rows and draws."""

import hashlib
import math
import random
from statistics import median

import pytest

from stopwise.operators import lanes, resample

REPS = 40


def shifted(score, head, log_r):
    z = math.log(score / (1 - score)) + (1 if head == "success" else -1) * log_r
    return 1 / (1 + math.exp(-z))


def odds(r, n):
    return math.log(r / n / (1 - r / n))


@pytest.fixture(scope="module")
def data():
    rng = random.Random(1)
    tasks = [f"t{i}" for i in range(9)]
    folds = [("one", p, s, m, h, l) for p, s, m, h, l in (("p1", "A", "m1", "success", 0.3), ("p2", "B", "m2", "failure", -0.2), ("p3", "A", "m3", "success", 0.1))]
    common = [(p, t) for p in ("p1", "p2", "p3") for t in tasks if rng.random() < 0.9]
    priors = [(p, t, 3, rng.randint(0, 3), 4, rng.randint(0, 4), 20, rng.randint(3, 17)) for p, t in common]
    cells = [(m, t, d, round(rng.uniform(0.5, 0.99), 2), n, rng.randint(0, n)) for m in ("m1", "m2", "m3") for t in [*tasks, "elsewhere"] for d in ("success", "failure", "undecided") for _ in range(6) for n in (rng.randint(1, 3),)]
    return folds, common, priors, cells


def plain(data, frozen, seed=7, least=20):
    folds, common, priors, cells = data
    per_rep = {}
    for scope, pair, side, model, head, log_r in folds:
        tasks = sorted((t for p, t in common if p == pair), key=lambda t: (hashlib.md5(t.encode()).hexdigest()[:2], t))
        for rep in range(REPS):
            drawn = [tasks[int(hashlib.md5(f"{seed}|{scope}|{pair}|{rep}|{i}".encode()).hexdigest()[:8], 16) % len(tasks)] for i in range(len(tasks))]
            own = [c for t in drawn for c in cells if c[0] == model and c[1] == t and c[2] == head]
            rows = [next(r for r in priors if r[:2] == (pair, t)) for t in drawn]
            target = (sum(r[3 if side == "A" else 5] for r in rows), sum(r[2 if side == "A" else 4] for r in rows))
            train = (sum(r[7] for r in rows), sum(r[6] for r in rows))
            used = log_r if frozen else odds(*target) - odds(*train)
            n = sum(c[4] for c in own)
            if n >= least:
                gap = sum(c[4] * shifted(c[3], head, used) for c in own) / n - sum(c[5] for c in own) / n
                per_rep.setdefault(rep, []).append(gap)
    return {rep: (median(g), median(map(abs, g))) for rep, g in per_rep.items()}


@pytest.mark.parametrize("frozen", [True, False])
def test_lanes_equal_a_loop(spark, data, frozen, monkeypatch):
    monkeypatch.setattr(lanes, "CHUNK", 7)
    monkeypatch.setattr(lanes, "STRIP", 3 * REPS)
    seen = {}
    original = lanes.medians

    def record(*args):
        seen["rows"] = original(*args)
        return seen["rows"]

    monkeypatch.setattr(lanes, "medians", record)
    folds, common, priors, cells = data
    frame = spark.createDataFrame
    found = resample.target_bootstrap(
        frame(folds, "scope string, pair_id string, side string, model_id string, head string, log_r double"),
        frame(common, "pair_id string, instance_id string"),
        frame(priors, "pair_id string, instance_id string, a_n long, a_r long, b_n long, b_r long, train_n long, train_r long"),
        frame(cells, "model_id string, instance_id string, decision string, decision_score double, n long, k long"),
        ["scope"], REPS, 7, frozen,
    )
    expected = plain(data, frozen)
    got = {r["rep"]: (r["median_gap"], r["median_abs_gap"]) for r in seen["rows"].collect()}
    assert got.keys() == expected.keys()
    for rep, values in expected.items():
        assert got[rep] == pytest.approx(values, abs=1e-12)
    assert [r["n_valid"] for r in found.collect()] == [len(expected)]
