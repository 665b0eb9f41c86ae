"""Grouped and whole-table aggregates.

All are partial + final aggregates, so a hot key reaches its reducer as one row per
map task, or, where its values are listed, one page at a time.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.columns import mean_of, space_tokens
from tidemill.operators.ranges import RANGE, find_ranges, with_range
from tidemill.shared import keep

#: Values on a page of a collected list.
PAGE_SIZE = 100_000


def word_count(lines: DataFrame, column: str = "text") -> DataFrame:
    """Count of every space-separated token, last word first."""
    return (
        lines.select(F.explode(space_tokens(column)).alias("word"))
        .groupBy("word")
        .agg(F.count("word").alias("count"))
        .orderBy(F.desc("word"))
    )


def count_and_max(
    df: DataFrame, key: str, counted: str, latest: str, names: tuple[str, str]
) -> DataFrame:
    return df.groupBy(key).agg(F.count(counted).alias(names[0]), F.max(latest).alias(names[1]))


def sum_by_key(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum(value).alias(name))


def mean_by_key(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """Mean from a mergeable (sum, count) pair; the same at any partitioning."""
    return (
        df.groupBy(key)
        .agg(F.sum(value).alias("_sum"), F.count(value).alias("_count"))
        .select(key, mean_of(F.col("_sum"), F.col("_count")).alias(name))
    )


def total(df: DataFrame, value: Column, name: str) -> DataFrame:
    return df.agg(F.sum(value).alias(name))


def collect_by_key(
    df: DataFrame,
    key: str | Column,
    value: str,
    *,
    key_name: str = "key",
    page_size: int = PAGE_SIZE,
) -> DataFrame:
    """Sorted values of every key in pages of ``page_size``: columns key, piece, values.

    The value of rank r, from 0, is on the page r div ``page_size``, whatever the size
    of the key. Nulls are left out; a key of nulls only has one empty page. Equal values
    are counted before the shuffle, and ranks are taken over ranges of (key, value), so
    neither a hot key nor a value repeated without end meets in one task.
    """
    key_column = F.col(key) if isinstance(key, str) else key
    keyed = df.select(key_column.alias(key_name), F.col(value).alias("_value"))
    runs = keep(keyed.groupBy(key_name, "_value").agg(F.count("_value").alias("_n")))
    order = [key_name, "_value"]
    cut = with_range(runs, order, find_ranges(runs, order).bounds)
    so_far = Window.partitionBy(RANGE, key_name).orderBy("_value").rowsBetween(
        Window.unboundedPreceding, 0
    )
    # one row per key and range it reaches into
    earlier = Window.partitionBy(key_name).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(key_name, RANGE).agg(F.sum("_n").alias("_sum"))
    offsets = sums.select(
        F.col(key_name).alias("_key"),
        F.col(RANGE).alias("_in_range"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
    )
    same = F.col(key_name).eqNullSafe(F.col("_key")) & (F.col(RANGE) == F.col("_in_range"))
    placed = (
        cut.withColumn("_end", F.sum("_n").over(so_far))
        .join(offsets, same)
        .withColumn("_end", F.col("_before") + F.col("_end"))
        .withColumn("_start", F.col("_end") - F.col("_n"))
    )
    page = f"greatest(_end - 1, _start) div {page_size}"
    paged = placed.withColumn(
        "piece", F.explode(F.expr(f"sequence(_start div {page_size}, {page})"))
    ).withColumn(
        "_here",
        F.expr(
            f"cast(least(_end, (piece + 1) * {page_size}) - greatest(_start, piece * {page_size}) as int)"
        ),
    )
    repeated = F.flatten(F.transform("_runs", lambda r: F.array_repeat(r["_value"], r["_here"])))
    return (
        paged.groupBy(key_name, "piece")
        .agg(F.sort_array(F.collect_list(F.struct("_value", "_here"))).alias("_runs"))
        .select(key_name, "piece", repeated.alias("values"))
    )


def table_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row and column count of every table; the counts read no columns."""
    profiles = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
        )
        for name, df in tables.items()
    ]
    return functools.reduce(DataFrame.unionByName, profiles)
