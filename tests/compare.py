"""Side-by-side comparison of registered queries with their SQL."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

from patronage.sources.tables import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def plain(value):
    """A value in a form that compares across the two engines."""
    if isinstance(value, decimal.Decimal):
        return format(value, "f")
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (dt.date, dt.datetime, bool)) or value is None:
        return str(value)
    return str(value)


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark_df, connection, sql: str) -> list[str]:
    """What differs between a Spark result and the SQL's; empty if nothing does."""
    result = connection.execute(sql)
    sql_names, sql_rows = _sorted_rows([d[0] for d in result.description], result.fetchall())
    names, rows = _sorted_rows(spark_df.columns, spark_df.collect())
    if names != sql_names:
        return [f"columns {names} against {sql_names}"]
    if len(rows) != len(sql_rows):
        return [f"{len(rows)} rows against {len(sql_rows)}"]
    found = []
    for ours, theirs in zip(rows, sql_rows):
        if ours != theirs:
            cells = [(n, a, b) for n, a, b in zip(names, ours, theirs) if a != b]
            found.append(str(cells))
    return found
