"""Operators that SQL can express, against DuckDB on the smallest tables."""

import os

import compare
import pytest

from stopwise.llm.queries import QUERIES, SQL

PATH = os.path.join(compare.DATA, "sf0.001")


@pytest.fixture(scope="module")
def con():
    return compare.duck(PATH)


@pytest.mark.parametrize("key", SQL)
def test_matches_sql(spark, con, key):
    names, mine = compare.spark_rows(QUERIES[key](spark, PATH))
    others, theirs, _ = compare.duck_rows(con, SQL[key])
    assert (names, mine) == (others, theirs) and mine
