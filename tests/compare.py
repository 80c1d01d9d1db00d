"""Compare a query's rows with its SQL, independent of row order."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os

import duckdb


def connect(sf_dir: str):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, float):
        return float(f"{value:.12g}")
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def differences(df, connection, sql: str) -> list[str]:
    """Nothing when both sides agree; otherwise what differs first."""
    result = connection.execute(sql)
    expected_columns = [column[0] for column in result.description]
    expected = _rows(expected_columns, result.fetchall())
    actual = _rows(df.columns, [tuple(row) for row in df.collect()])
    if sorted(df.columns) != sorted(expected_columns):
        return [f"columns {sorted(df.columns)} != {sorted(expected_columns)}"]
    if len(actual) != len(expected):
        return [f"{len(actual)} rows != {len(expected)}"] + [f"only one side: {r}" for r in list(set(map(repr, actual)) ^ set(map(repr, expected)))[:4]]
    return [f"{a} != {e}" for a, e in zip(actual, expected) if a != e][:3]
