"""Compares a query with its SQL on the same tables."""

from __future__ import annotations

import math
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else round(v, 9))
    if hasattr(v, "isoformat"):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if v.__class__.__name__ == "Decimal":
        return float(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(spark, con, name, run, sql, folder):
    """None when equal, else a short description of the difference; also both times."""
    t0 = time.time()
    df = run(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return (None if got[1] else "no rows"), t1 - t0, 0.0, len(got[1])
    rel = con.execute(sql)
    want = rows_of([c[0] for c in rel.description], rel.fetchall())
    t2 = time.time()
    n = len(got[1])
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", t1 - t0, t2 - t1, n
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return (f"rows {len(got[1])} vs {len(want[1])}; only here {[str(x)[:600] for x in list(a - b)[:2]]}; "
                f"only in SQL {[str(x)[:600] for x in list(b - a)[:2]]}"), t1 - t0, t2 - t1, n
    return None, t1 - t0, t2 - t1, n
