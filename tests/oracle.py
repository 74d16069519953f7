"""Runs a query and its SQL side by side and compares rows and column names."""

from __future__ import annotations

import datetime
import os


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def plain(v):
        if isinstance(v, float):
            return float(f"{v:.9g}")
        if isinstance(v, datetime.datetime):
            return v.isoformat()
        return v

    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        name = f.removesuffix(".parquet")
        path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def compare(spark, query, sql: str, sf_dir: str, con=None) -> str:
    """Empty if both agree, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = (con or connect(sf_dir)).execute(sql)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] != want[1]:
        a, b = set(map(repr, got[1])), set(map(repr, want[1]))
        return f"{len(got[1])} and {len(want[1])} rows; only Spark {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"
    return "" if got[1] else "no rows"
