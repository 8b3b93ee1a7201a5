"""Pair ids and whole-row deduplication."""

from stopwise.operators import ingest, pairs


def test_pair_ids_are_distinct_for_many_models(spark):
    names = spark.createDataFrame([(f"model-{i:03d}",) for i in range(120)], "model_id string")
    found = pairs.unordered_pairs(names, "model_id")
    assert found.count() == 120 * 119 // 2
    assert found.select("pair_id").distinct().count() == 7140


def test_first_row_stays_whole(spark):
    rows = [(1, 5, "b", None), (1, 3, "z", 1), (1, 3, "a", 9), (2, 1, None, 4)]
    frame = spark.createDataFrame(rows, "k int, o int, x string, y int")
    found = sorted(map(tuple, ingest.dedup_first(frame, "k", ["o"]).collect()))
    assert found == [(1, 3, "a", 9), (2, 1, None, 4)]
