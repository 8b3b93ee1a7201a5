"""Tiles of vectors meet in waves: a wave sends a bounded share of all pairs, and its shuffle ends with it."""

import numpy as np
import pytest
from test_join_operators import lowest

from stopwise.llm import embeddings


def test_waves_send_two_tiles_for_each_there_is():
    pairs = [(i, j) for i in range(40) for j in range(i, 40)]
    dealt = list(embeddings.waves(pairs, 40, 8e6))
    assert sorted(p for wave in dealt for p in wave) == pairs
    assert max(len(wave) for wave in dealt) <= 40
    assert max(sum(len(set(p)) for p in wave) for wave in dealt) <= 2 * 40
    assert len(list(embeddings.waves(pairs, 40, 1000))) == 1  # little data meets at once


def test_tiles_are_bounded_and_of_one_length():
    tile = embeddings.tiles_of(np.full(1000, 2048), np.repeat([3, 64], [10, 990]))
    assert np.bincount(tile).max() == 16 and (np.diff(tile) >= 0).all() and tile[9] != tile[10]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_no_link_is_lost_between_tiles_of_several_waves(spark, monkeypatch, spread):
    for name, value in {"CELL": 50, "BLOCK": 20, "TILE": 60, "WAVE_BYTES": 1}.items():
        monkeypatch.setattr(embeddings, name, value)
    written, write = [], embeddings.materialize_all
    monkeypatch.setattr(embeddings, "materialize_all", lambda frames, name: write((written.append(f) or f for f in frames), name))
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 8))[rng.integers(0, 40, 400)] + rng.normal(size=(400, 8)) * spread
    found = {r.vec_id: r for r in embeddings.near_dedup(spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    assert {i: r.n_links for i, r in found.items()} == {i: int(n) for i, n in enumerate(linked.sum(1))}
    assert {i: r.component_id for i, r in found.items()} == lowest(range(400), list(zip(*np.nonzero(linked))))
    assert len(written) > 1
