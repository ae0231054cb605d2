"""Compares a query with its SQL in DuckDB as row multisets, columns sorted by name."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, Counter(tuple(_plain(row[n]) for n in names) for row in df.collect())


def duckdb_rows(con, sql: str):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = cursor.fetchall()
    return [columns[i] for i in order], Counter(
        tuple(_plain(row[i]) for i in order) for row in rows)


def difference(df, con, sql: str) -> str:
    """Empty when both sides agree, else a short description."""
    names, left = spark_rows(df)
    other, right = duckdb_rows(con, sql)
    if names != other:
        return f"columns {names} / {other}"
    if left == right:
        return ""
    return (f"rows {sum(left.values())}/{sum(right.values())}, "
            f"only spark {list((left - right).items())[:3]}, "
            f"only sql {list((right - left).items())[:3]}")
