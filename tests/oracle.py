"""Compares a query with its SQL on the same tables: names, row counts, values."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([_plain(r[i]) for i in order] for r in rows), key=repr)


def difference(df, con, sql: str) -> str:
    """Empty if equal."""
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names, want = [c[0] for c in cur.description], cur.fetchall()
    if sorted(names) != sorted(got_names):
        return f"columns {sorted(got_names)} {sorted(names)}"
    a, b = _rows(got_names, got), _rows(names, want)
    if a == b:
        return ""
    other = next(((x, y) for x, y in zip(a, b, strict=False) if x != y), None)
    return f"{len(a)} rows, {len(b)} expected; first difference {other}"
