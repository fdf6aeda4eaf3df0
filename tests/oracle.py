"""Compare a registered query with its DuckDB twin the way the driver does."""

from __future__ import annotations

import math

import duckdb

from tallyframe.checks.views import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return str(v.asDict())
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def kinds(rows):
    """Value type per column (ignoring NULLs): catches int vs float vs decimal mismatches."""
    if not rows:
        return []
    return [sorted({type(r[i]).__name__ for r in rows if r[i] is not None}) for i in range(len(rows[0]))]


def compare(spark, con, query, sql, sf_dir):
    """Return (row count, error text or None)."""
    df = query(spark, sf_dir)
    cols, got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    wcols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if cols != wcols:
        return len(got), f"columns {cols} != {wcols}"
    if len(got) != len(want):
        return len(got), f"rows {len(got)} != {len(want)}; e.g. {got[:2]} vs {want[:2]}"
    if got != want:
        i = next(i for i, (a, b) in enumerate(zip(got, want)) if a != b)
        return len(got), f"{cols}\n   spark {got[i]}\n  duckdb {want[i]}"
    if kinds(got) != kinds(want):
        return len(got), f"types {kinds(got)} != {kinds(want)}"
    return len(got), None
