"""Compare a Spark result with the answer DuckDB gives to the plan's SQL."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

import duckdb

from tidemill.plans.registry import TABLES, table_path


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{table_path(sf_dir, name)}'")
    return connection


def plain(value):
    """A form in which equal values of the two engines are equal."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, decimal.Decimal)):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return (
        [columns[i] for i in order],
        Counter(tuple(plain(row[i]) for i in order) for row in rows),
    )


def difference(df, connection, sql: str) -> str | None:
    """None when the results agree, else a short description."""
    cursor = connection.execute(sql)
    names, wanted = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    got_names, got = rows_of(df.columns, df.collect())
    if names != got_names:
        return f"columns {got_names} != {names}"
    if got == wanted:
        return None
    missing, extra = wanted - got, got - wanted
    return (
        f"{sum(got.values())} rows, wanted {sum(wanted.values())}; "
        f"missing {list(missing)[:3]}, extra {list(extra)[:3]}"
    )
