"""Compare a query with its oracle, value by value."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _value(v):
    if isinstance(v, float) and v == 0:
        return 0.0  # no signed zero
    return v


def as_rows(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return sorted(df.columns), as_rows(df.columns, [tuple(r) for r in df.collect()])


def oracle_rows(con, text):
    cur = con.execute(text)
    columns = [d[0] for d in cur.description]
    return sorted(columns), as_rows(columns, cur.fetchall())
