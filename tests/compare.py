"""Runs registered queries on Spark and their oracles on DuckDB, and compares rows regardless of order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(_cell, x)) + "]"
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return f"{float(x):.9g}"
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def connect(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return con


def compare(spark, con, sf_dir, query, sql):
    """None if equal, else what differs."""
    frame = query(spark, sf_dir)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} and {sorted(names)}"
    if got != want:
        a, b = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
        return f"{len(got)} and {len(want)} rows; only in Spark {a}; only in DuckDB {b}"
    return None
