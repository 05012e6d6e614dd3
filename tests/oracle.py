"""Runs a query's SQL twin in DuckDB over the same Parquet tables and compares whole results."""

from __future__ import annotations

import glob
import math
import os
from decimal import Decimal

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, Decimal):
        return float(v)
    return v


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in got.fetchall()), key=repr)


def mismatch(a: tuple, b: tuple, tolerance: float = 0.0) -> str:
    """'' if both results are equal (floats within the tolerance), else the first difference."""
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} and {len(b[1])} rows"
    for x, y in zip(a[1], b[1]):
        for c, u, v in zip(a[0], x, y):
            same = u == v or (isinstance(u, float) and isinstance(v, float) and abs(u - v) <= tolerance * max(1.0, abs(v)))
            if not same or (isinstance(u, bool) != isinstance(v, bool)):
                return f"{c}: {u!r} and {v!r} in {x} and {y}"
    return ""
