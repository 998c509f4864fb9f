"""Compare registered queries with their SQL on the given tables."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

from queries import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(sf_dir, name)}.parquet'")
    return connection


def normal(value):
    if isinstance(value, bool) or value is None or isinstance(value, (str, int)):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return float(value) if hasattr(value, "as_integer_ratio") else str(value)


def table(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, connection, run, sql: str, sf_dir: str) -> str | None:
    """None when both give the same columns and rows, otherwise what differs first."""
    found = run(spark, sf_dir)
    mine = table(found.columns, found.collect())
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = table(names, cursor.fetchall())
    if sorted(found.columns) != sorted(names):
        return f"columns {sorted(found.columns)} != {sorted(names)}"
    if len(mine) != len(expected):
        return f"{len(mine)} rows != {len(expected)}"
    for a, b in zip(mine, expected):
        if a != b:
            return f"{str(a)[:400]} != {str(b)[:400]}"
    return None
