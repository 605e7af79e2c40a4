"""Comparison of a Spark result with DuckDB's on the same tables."""

from __future__ import annotations

import datetime
import decimal
import math

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 6) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str | None:
    """None if both have the same columns and rows, else what differs."""
    found = con.sql(sql)
    a_cols, a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    b_cols, b = rows_of(found.columns, found.fetchall())
    if a_cols != b_cols:
        return f"columns {a_cols} and {b_cols}"
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    for x, y in zip(a, b, strict=True):
        if x != y:
            return f"{x} and {y}"
    return None
