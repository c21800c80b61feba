"""Queries held against their SQL in DuckDB, as the driver does: columns by name, rows as a multiset."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return tuple(map(cell, v)) if isinstance(v, (list, tuple)) else v


def connection(sf: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def differences(df, c: duckdb.DuckDBPyConnection, sql: str) -> str:
    """What sets a Spark result and a DuckDB result apart; empty if nothing does."""
    rows = df.collect()
    found = c.execute(sql)
    names = [x[0] for x in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    kinds = dict(zip(names, [str(x[1]) for x in found.description]))
    odd = {k: (t, kinds[k]) for k, t in df.dtypes if {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}.get(t, kinds[k]) != kinds[k]}
    order = sorted(names)
    a = Counter(tuple(cell(r[n]) for n in order) for r in rows)
    at = [names.index(n) for n in order]
    b = Counter(tuple(cell(r[i]) for i in at) for r in found.fetchall())
    if a != b:
        return f"{len(rows)} and {sum(b.values())} rows; only in Spark {list((a - b).items())[:3]}, only in SQL {list((b - a).items())[:3]}"
    return f"types {odd}" if odd else "" if rows else "no rows"
