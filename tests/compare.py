"""A query's rows held against DuckDB's rows of its SQL."""

from __future__ import annotations

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def close(a, b) -> bool:
    if isinstance(a, bool) or isinstance(b, bool):
        return a == b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a == b or abs(a - b) <= 1e-9 * max(abs(a), abs(b), 1e-3)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(close, a, b))
    return a == b


def order(row: tuple):
    return tuple((x is not None, f"{x:020.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)) for x in row)


def differences(df, sql: str, folder: str) -> list:
    columns = sorted(df.columns)
    got = sorted((plain(tuple(r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=order)
    found = connection(folder).sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    expected = sorted((plain(tuple(r[i] for i in at)) for r in found.fetchall()), key=order)
    assert len(got) == len(expected)
    return [(a, b) for a, b in zip(got, expected, strict=True) if not close(a, b)]
