"""Side-by-side comparison of a Spark result with its SQL."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(repr(value))
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql, show=4):
    """An empty list when both sides have the same columns and the same rows."""
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    right = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    problems = []
    if left[0] != right[0]:
        problems.append(f"columns {left[0]} / {right[0]}")
    if len(left[1]) != len(right[1]):
        problems.append(f"rows {len(left[1])} / {len(right[1])}")
    if left[1] != right[1]:
        from collections import Counter

        ours, theirs = Counter(map(repr, left[1])), Counter(map(repr, right[1]))
        problems += [f"only Spark: {r[:600]}" for r in list((ours - theirs))[:show]]
        problems += [f"only SQL:   {r[:600]}" for r in list((theirs - ours))[:show]]
    return problems
