"""Compare a Spark query with its DuckDB SQL on the same tables."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"create view {name} as select * from read_parquet('{path}')")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime) and value.tzinfo is None:
        return value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def as_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    found = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(found, key=repr)


def difference(df, sql: str, folder: str) -> str | None:
    """None if both sides give the same rows, else a short account."""
    left_names, left = as_rows(df.columns, [tuple(r) for r in df.collect()])
    connection = oracle_connection(folder)
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    right_names, right = as_rows(names, result.fetchall())
    if left_names != right_names:
        return f"columns {left_names} against {right_names}"
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(wrong)} of {len(left)} rows differ, first {wrong[0]}" if wrong else None
