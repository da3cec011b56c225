"""Compare a query with its DuckDB counterpart: columns, row count and values, whatever the order."""

from __future__ import annotations

import math
import os

import duckdb

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir: str = SF_DIR):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(v[i]) for i in order)) for v in values)


def compare(spark, con, query, sql: str, sf_dir: str = SF_DIR) -> None:
    found = query(spark, sf_dir)
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(found.columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(columns, want.fetchall())
