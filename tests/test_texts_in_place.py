"""Texts whose key does not repeat are counted where they lie; rows are encoded in waves."""

from pyspark.sql import functions as F

from stopwise.operators import text


def test_only_texts_of_repeated_keys_travel(spark):
    letters = "abcdefghijklmnopqrst"
    long = [" ".join(letters[(i * j) % 20] + letters[(i + j * j) % 20] + str(i * j) for j in range(3000)) for i in range(60)]
    rows = [(i, "x", t) for i, t in enumerate(long)] + [(7, "y", "one more"), (None, "x", "aa bb"), (None, "y", "bb cc"), (100, "x", None)]
    docs = spark.createDataFrame(rows, "row_id long, kind string, text string")
    grouped = text.texts_by_key(docs, ["row_id"], "text")
    found = {r.row_id: sorted(r._texts) for r in grouped.collect()}
    assert found == {i: [t] for i, t in enumerate(long) if i != 7} | {7: sorted([long[7], "one more"]), None: ["aa bb", "bb cc"], 100: []}
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert "left_anti" in plan.lower().replace("leftanti", "left_anti") and "hashpartitioning(row_id" in plan
    assert sorted(r.term for r in text.term_counts(docs, ["row_id"], "text").where("row_id IS NULL").collect()) == ["aa", "aa bb", "bb", "bb cc", "cc"]


def test_waves_encode_every_row_once(spark, monkeypatch):
    monkeypatch.setattr(text, "WAVE_ROWS", 10)
    waves, write = [], text.materialize_all
    monkeypatch.setattr(text, "materialize_all", lambda frames, name: write((waves.append(f) or f for f in frames), name))
    rows = [(i, " ".join(f"w{(i * j) % 9}" for j in range(i % 12))) for i in range(45)] + [(3, "w1 w2"), (None, "w1 w3 w1"), (None, "w3"), (99, None)]
    docs = spark.createDataFrame(rows, "row_id long, text string").repartition(3)
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    plain = text.global_encode(text.term_counts(docs, ["row_id"], "text"), n).groupBy("row_id")
    plain = plain.agg(F.count(F.lit(1)).alias("terms"), F.sum("cnt").alias("total"), F.sum("term_id").alias("id_sum"))
    found = text.global_totals(docs, n)
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect())) and found.count() > 30
    assert len(waves) == 5
