"""Compare Spark results with DuckDB on the same parquet tables.

    python tests/compare.py sf0.01 [key-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

DATA = os.environ.get("TESTDATA_DIR", "/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    return con


def normal(row: dict) -> tuple:
    out = []
    for name in sorted(row):
        v = row[name]
        if isinstance(v, float) and math.isnan(v):
            v = "nan"
        out.append(repr(v))
    return tuple(out)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), sorted(normal(r.asDict()) for r in df.collect())


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple], list[str]]:
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    return sorted(names), sorted(normal(dict(zip(names, r))) for r in rel.fetchall()), [str(d[1]) for d in rel.description]


def check(query, spark, con, path: str) -> str:
    """'' when equal, else what differs."""
    cols, mine = spark_rows(query.run(spark, path))
    if query.sql is None:
        return "" if mine else "no rows"
    names, theirs, _ = duck_rows(con, query.oracle())
    if cols != names:
        return f"columns {cols} vs {names}"
    if mine != theirs:
        a, b = set(mine), set(theirs)
        return f"rows {len(mine)} vs {len(theirs)}; only spark {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]}"
    return "" if mine else "EMPTY on both sides"


def main() -> int:
    from stopwise.plans.registry import all_queries
    from stopwise.session import local_session

    path = os.path.join(DATA, sys.argv[1])
    wanted = sys.argv[2:]
    spark, con, bad = local_session(8), duck(path), 0
    for key, query in all_queries().items():
        if wanted and not any(key.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            problem = check(query, spark, con, path)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem)
        print(f"{'BAD ' if problem else 'ok  '} {key} {time.time() - start:.1f}s {problem}", flush=True)
    print("problems:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main())
