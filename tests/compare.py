"""Runs a query and its SQL over the same tables and compares rows, whatever their order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def same(df, sql: str, d: str) -> None:
    con = duckdb.connect()
    for f in glob.glob(f"{d}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())
