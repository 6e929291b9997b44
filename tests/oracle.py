"""Holds a query against its SQL as the driver does: rows, columns by name, values without order."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "as_integer_ratio") and not isinstance(v, (int, bool)):
        return float(v)
    return v


def rows_of_spark(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def rows_of_duckdb(con, sql):
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)


def difference(df, con, sql) -> str:
    columns, left = rows_of_spark(df)
    names, right = rows_of_duckdb(con, sql)
    if columns != names:
        return f"columns {columns} and {names}"
    if left != right:
        a, b = set(map(repr, left)), set(map(repr, right))
        return f"{len(left)} and {len(right)} rows; only here: {sorted(a - b)[:3]}; only in SQL: {sorted(b - a)[:3]}"
    return ""
