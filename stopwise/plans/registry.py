"""One entry per operator: the Spark plan, its output columns, and the SQL that must agree."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.plans import oracle
from stopwise.session import tune
from stopwise.sources.tables import Tables

SPARK_TYPES = {"s": "string", "i": "bigint", "d": "double", "b": "boolean"}
SQL_TYPES = {"s": "VARCHAR", "i": "BIGINT", "d": "DOUBLE", "b": "BOOLEAN"}
DIGITS = 9


@dataclass(frozen=True)
class Query:
    key: str
    columns: str
    plan: Callable[[Tables], DataFrame]
    sql: str | None = None
    digits: int = DIGITS

    @property
    def fields(self) -> list[tuple[str, str]]:
        return [tuple(part.split(":")) for part in self.columns.split()]

    def run(self, spark: SparkSession, path: str) -> DataFrame:
        df = self.plan(Tables(tune(spark), path))
        out = []
        for name, kind in self.fields:
            col = F.col(name).cast(SPARK_TYPES[kind])
            if kind == "d":
                # adding zero turns a rounded -0.0 into 0.0
                col = F.round(col, self.digits) + F.lit(0.0)
            out.append(col.alias(name))
        return df.select(*out)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cast = lambda n, k: (
            f"round(CAST({n} AS DOUBLE), {self.digits}) + 0.0 AS {n}" if k == "d" else f"CAST({n} AS {SQL_TYPES[k]}) AS {n}"
        )
        wanted = ", ".join(cast(n, k) for n, k in self.fields)
        return oracle.statement(f"SELECT {wanted} FROM (\n{self.sql}\n) AS result")


def once(keep: bool = False):
    """Compose a frame once per query run; with ``keep`` also write its rows once.

    Keep small results that several branches use (counts, cells, fold tables), so that the tables
    behind them are scanned once.
    """

    def wrap(build):
        name = f"{build.__module__.rsplit('.', 1)[-1]}-{build.__name__}"

        @functools.wraps(build)
        def inner(t: Tables) -> DataFrame:
            return t.once(name, lambda: build(t), keep)

        return inner

    return wrap


def all_queries() -> dict[str, Query]:
    from stopwise.plans import catalog

    found: dict[str, Query] = {}
    for query in catalog.QUERIES:
        if query.key in found:
            raise ValueError(f"duplicate query {query.key}")
        found[query.key] = query
    return found
