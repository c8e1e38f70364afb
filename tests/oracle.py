"""Runs a query and its SQL on the same tables, and compares rows without order."""

from __future__ import annotations

import math
import os

import duckdb

from tallyweave.plans.views import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def value(v) -> str:
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v) + 0:.7g}"
    return str(v)


def compare(spark, con, sf_dir: str, run, sql: str) -> int:
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(tuple(value(r[c]) for c in names) for r in df.collect())
    found = con.execute(sql)
    columns = [x[0] for x in found.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    assert got == sorted(tuple(value(x[k]) for k in at) for x in found.fetchall())
    return len(got)
