"""Checks of query results and of the presence of tables, as one frame."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CheckFailed(AssertionError):
    """One or more checks did not hold."""


def check_results(checks: Mapping[str, tuple[DataFrame, object]]) -> DataFrame:
    """Compare the first cell of each query with the expected value.

    Columns: check, actual, expected (as text) and ok. A query without rows has
    a null cell, which equals only an expected None.
    """
    rows = []
    for name, (query, expected) in checks.items():
        column = query.columns[0]
        first = query.limit(1).agg(F.first(F.col(f"`{column}`")).alias("_cell"))
        kind = first.schema["_cell"].dataType
        wanted = F.lit(expected).cast(kind)
        rows.append(
            first.select(
                F.lit(name).alias("check"),
                F.col("_cell").cast("string").alias("actual"),
                wanted.cast("string").alias("expected"),
                F.col("_cell").eqNullSafe(wanted).alias("ok"),
            )
        )
    return functools.reduce(DataFrame.unionByName, rows)


def check_tables(spark: SparkSession, tables: Sequence[str]) -> DataFrame:
    """One row per table name: whether the catalog has it."""
    found = {name: spark.catalog.tableExists(name) for name in tables}
    rows = [(f"table {name}", str(ok).lower(), "true", ok) for name, ok in found.items()]
    return spark.createDataFrame(rows, "check string, actual string, expected string, ok boolean")


def require(checked: DataFrame) -> DataFrame:
    """Raise when a check failed; the frame has one row per check."""
    failed = [f"{r['check']}: {r['actual']} != {r['expected']}" for r in checked.where("NOT ok").collect()]
    if failed:
        raise CheckFailed("; ".join(failed))
    return checked
