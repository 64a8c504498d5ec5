"""Comparing a registered query with its oracle SQL."""

from __future__ import annotations

import math
import os
from datetime import datetime

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(directory: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(directory, t)}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.9g}")
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dict):  # a struct, whose fields come in order
        value = tuple(value.values())
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=repr)


def compare(df, con, sql: str) -> int:
    """Assert equal columns, rows and values; return the row count."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    expected = _sorted(names, result.fetchall())
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    actual = _sorted(df.columns, [tuple(r) for r in df.collect()])
    assert len(actual) == len(expected), f"{len(actual)} rows, oracle has {len(expected)}"
    for a, e in zip(actual, expected):
        assert a == e, f"{a} != {e}"
    return len(actual)
