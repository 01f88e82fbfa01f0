"""Queries against their SQL, by DuckDB."""

from __future__ import annotations

import os

import duckdb


def same(spark, sf_dir: str, query, sql: str) -> int:
    """The query's rows, in any order, are those of the SQL, and the columns have the same names; how many rows."""
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    df, want = query(spark, sf_dir), con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    rows = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    assert rows == sorted(map(repr, want.project(", ".join(f'"{c}"' for c in columns)).fetchall()))
    return len(rows)
