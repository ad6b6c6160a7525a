"""Compares a Spark query with SQL on the same Parquet tables, without regard to order."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb


def value(x):
    if isinstance(x, float):
        return round(x, 9)
    if isinstance(x, decimal.Decimal):
        return round(float(x), 9)
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        name = f.split(".")[0]
        path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def key(row):
    return tuple((x is None, str(x)) for x in row)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(([value(r[n]) for n in names] for r in df.collect()), key=key)


def sql_rows(con, sql: str):
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    names = sorted(cols)
    at = [cols.index(n) for n in names]
    return names, sorted(([value(r[i]) for i in at] for r in rel.fetchall()), key=key)


def differences(df, con, sql: str) -> str:
    (n1, a), (n2, b) = spark_rows(df), sql_rows(con, sql)
    if n1 != n2:
        return f"columns {n1} and {n2}"
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    odd = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(odd)} of {len(a)} rows differ, first {odd[0]} in {n1}" if odd else ""
