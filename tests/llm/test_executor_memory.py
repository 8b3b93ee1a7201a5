"""What executors and their Python workers hold besides the work itself."""

import subprocess
import sys

import pytest
from conftest import ROOT

from stopwise.llm import queries, secrets
from stopwise.session import local_frame


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_workers_import_no_spark_ml():
    used = ("bpe", "mixing", "ngram_join", "secrets", "toxicity")
    code = f"import sys; sys.path.insert(0, {ROOT!r}); import pyspark.worker\nfrom stopwise.llm import {', '.join(used)}\nprint(*sys.modules)"
    found = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert "stopwise.llm.secrets" in found and "stopwise.llm.bpe" in found
    assert not {"pyspark.ml", "pandas"} & set(found)


@pytest.mark.parametrize("rows", [[(1.0, [2.0, 3.0]), (0.0, [])], []])
def test_rows_of_the_driver_start_no_workers(spark, rows):
    frame = local_frame(spark, rows, "label double, raw array<double>")
    assert "LocalTableScan" in plan(frame) and "ExistingRDD" not in plan(frame)
    assert [tuple(r) for r in frame.collect()] == rows
    assert frame.dtypes == [("label", "double"), ("raw", "array<double>")]


def test_secrets_are_learnt_without_python_rows(spark, monkeypatch):
    """Lists given to createDataFrame would be copied by workers of another kind."""
    docs = local_frame(spark, [(i, f"word and text {i} " * 20, "en", "docs/a") for i in range(40)], "doc_id long, text string, lang string, source string")
    given, create = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: given.append(type(data).__name__) or create(self, data, *a, **b))
    secrets.train(docs, trees=2, depth=2)
    assert given == ["Table", "Table"]


def test_few_texts_are_read_at_once(spark):
    before = spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")
    try:
        queries.small_batches(spark)
        assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) == queries.READ_ROWS <= 512
    finally:
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", before)
