"""Compare registered queries with their oracle SQL.

    python -m tests.parity [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf) / f"{name}.parquet"
        con.sql(f"create view {name} as select * from '{path}'")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    return frame.sort_values(list(frame.columns), na_position="first").reset_index(drop=True)


def difference(spark, con, query, sql: str, sf: str) -> str | None:
    """None when both results are equal in columns, kinds of type and values."""
    ours = canonical(query(spark, sf).toPandas())
    theirs = canonical(con.sql(sql).df())
    if list(ours.columns) != list(theirs.columns):
        return f"columns {list(ours.columns)} != {list(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    for column in ours.columns:
        a, b = ours[column], theirs[column]
        if {a.dtype.kind, b.dtype.kind} == {"i", "f"} and a.isna().any() and b.isna().any():
            a, b = a.astype("Int64"), b.astype("Int64")  # integers with nulls
        if len(a) and a.dtype.kind != b.dtype.kind:
            return f"{column}: {a.dtype} != {b.dtype}"
        same = ((a == b) | (a.isna() & b.isna())).fillna(False)
        if not same.all():
            at = same.idxmin()
            return f"{column}: {(~same).sum()} differ, first {a[at]!r} != {b[at]!r}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from finchlab.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failures = 0
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        sql = oracle_sql().get(name)
        start = time.time()
        try:
            if sql is None:
                problem = None if query(spark, sf).collect() else "no rows"
            else:
                problem = difference(spark, con, query, sql, sf)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failures += problem is not None
        print(f"{name:28s} {time.time() - start:6.1f}s {problem or 'ok'}", flush=True)
    print("failures:", failures)
    return failures


if __name__ == "__main__":
    sys.exit(main())
