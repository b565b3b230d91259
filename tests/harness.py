"""Compares a query with its SQL as the driver does: columns by name, rows in any order."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}".rstrip("0").rstrip(".")
    if isinstance(v, datetime.datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows(columns: list[str], data) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


def compare(df, con, sql: str) -> str | None:
    rel = con.sql(sql)
    want, got = rows(rel.columns, rel.fetchall()), rows(df.columns, df.collect())
    if want[0] != got[0]:
        return f"columns {got[0]} instead of {want[0]}"
    if want[1] != got[1]:
        a, b = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
        return f"{len(got[1])} rows instead of {len(want[1])}; only here {sorted(a)[:2]}, only there {sorted(b)[:2]}"
    return None
