"""Run a query on Spark and its SQL twin on DuckDB and compare whole results."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def spark_rows(df):
    return df.columns, [tuple(r) for r in df.collect()]


def differences(df, sql: str, con) -> list[str]:
    """Empty when columns, types and values agree."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    expected = bag(names, cur.fetchall())
    columns, rows = spark_rows(df)
    if sorted(columns) != sorted(names):
        return [f"columns {sorted(columns)} != {sorted(names)}"]
    actual = bag(columns, rows)
    problems = []
    if len(actual) != len(expected):
        problems.append(f"rows {len(actual)} != {len(expected)}")
    bad = [(a, e) for a, e in zip(actual, expected) if a != e or [type(x) for x in a] != [type(x) for x in e]]
    if bad:
        problems.append(f"{len(bad)} rows differ; columns {sorted(columns)}; first: {bad[:2]}")
    return problems
