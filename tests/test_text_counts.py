"""Terms are counted inside their rows: only texts travel, and ids that repeat are one row."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from stopwise.operators import text

ROWS = [(1, "de", "s", "Aa bb aa bb x"), (2, "de", "t", None), (3, "en", "s", ""), (1, "en", "s", "aa cc")]


def rows(spark):
    return spark.createDataFrame(ROWS, "row_id long, model_id string, instance_id string, text string")


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


def test_counts_of_repeated_ids_and_empty_texts(spark):
    got = {(r["row_id"], r["term"]): r["cnt"] for r in text.term_counts(rows(spark), ["row_id"], "text").collect()}
    assert got == {(1, "aa"): 3, (1, "bb"): 2, (1, "cc"): 1, (1, "aa bb"): 2, (1, "bb aa"): 1, (1, "aa cc"): 1}


def test_terms_are_not_shuffled_by_row(spark):
    counts = text.term_counts(rows(spark), ["row_id"], "text")
    assert plan(counts).count("Exchange hashpartitioning") == 1
    assert "hashpartitioning(row_id" in plan(counts) and "hashpartitioning(row_id#0L, term" not in plan(counts)
    vocab = spark.createDataFrame([("f", "aa", 0, 1.0)], "fold string, term string, term_id long, idf double")
    assert "hashpartitioning(term" not in plan(text.raw_tfidf(counts, vocab)).replace("hashpartitioning(term#", "", 1)


def test_fold_vocabulary_counts_each_place_of_a_repeated_id(spark):
    cells = spark.createDataFrame([("f", "de", "s", "train"), ("f", "en", "s", "train"), ("g", "en", "s", "train"), ("g", "de", "t", "test")], "fold string, model_id string, instance_id string, role string")
    found = text.fold_vocabulary(rows(spark), cells, min_df=1).where(F.col("term") == "aa").collect()
    # row 1 lies in two training cells of f and in one of g; its texts count as one row
    assert {(r["fold"], r["df"], r["tf"], r["n"]) for r in found} == {("f", 2, 6, 3), ("g", 1, 3, 2)}
