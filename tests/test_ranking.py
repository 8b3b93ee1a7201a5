"""Numbering and top-k lists against sorting, on a skewed alphabet."""

import random

from pyspark.sql import functions as F

from stopwise.operators import ranking


def words(n, seed):
    rng = random.Random(seed)
    return sorted({"th" + "".join(rng.choice("abé") for _ in range(rng.randint(1, 12))) for _ in range(n)})


def test_range_ids_follow_the_order(spark):
    groups = {"hot": words(4000, 1), "cold": words(30, 2), "": ["x"]}
    rows = [(g, w, i) for g, ws in groups.items() for i, w in enumerate(ws)]
    random.Random(3).shuffle(rows)
    out = ranking.range_ids(spark.createDataFrame(rows, "g string, w string, i long").repartition(5), ["g"], ["w"], "n")
    assert all(r["n"] == r["i"] and r["n_total"] == len(groups[r["g"]]) for r in out.collect()) and out.count() == len(rows)
    whole = ranking.range_ids(spark.range(100).select((99 - F.col("id")).alias("v")), [], ["v"], "n")
    assert all(r["n"] == r["v"] and r["n_total"] == 100 for r in whole.collect())
    assert ranking.range_ids(spark.createDataFrame([], "g string, w string"), ["g"], ["w"], "n").count() == 0


def test_a_hot_group_is_many_ranges(spark):
    rows = spark.createDataFrame([("hot", w) for w in words(8000, 4)], "g string, w string")
    placed = rows.repartitionByRange(8, "g", "w").groupBy(F.spark_partition_id()).count()
    sizes = [r["count"] for r in placed.collect()]
    assert max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]


def test_top_by_takes_ties_in_key_order(spark):
    rng = random.Random(5)
    rows = [(g, f"k{i:03}", rng.randint(1, 6)) for g, n in (("a", 200), ("b", 7), ("c", 50)) for i in range(n)]
    frame = spark.createDataFrame(rows, "g string, k string, s long")
    for k in (1, 10, 60, 500):
        expected = {(g, key) for g in "abc" for _, key in sorted((-s, key) for h, key, s in rows if h == g)[:k]}
        assert {(r["g"], r["k"]) for r in ranking.top_by(frame, ["g"], "s", "k", k).collect()} == expected
    assert [r["k"] for r in ranking.top_by(frame.where("g = 'b'").drop("g"), [], "s", "k", 3).orderBy(F.desc("s"), "k").collect()] == [k for _, k in sorted((-s, k) for g, k, s in rows if g == "b")[:3]]
