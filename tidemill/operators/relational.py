"""Projections, filters, joins and ordered reports."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.skew import spread_join


def fold_any(conditions: Sequence[Column]) -> Column:
    """OR of a list of conditions; false for an empty list."""
    return functools.reduce(operator.or_, conditions) if conditions else F.lit(False)


def fold_all(conditions: Sequence[Column]) -> Column:
    """AND of a list of conditions; true for an empty list."""
    return functools.reduce(operator.and_, conditions) if conditions else F.lit(True)


def filter_equal_sorted(
    df: DataFrame, column: str, value, order_by: str, tie_break: Sequence[str] = ()
) -> DataFrame:
    """Rows with the value, sorted. Equal keys of a sort stay in one task, so
    ``tie_break`` columns let Spark cut a key that holds many rows."""
    return df.filter(F.col(column) == F.lit(value)).orderBy(F.col(order_by).asc(), *tie_break)


def filter_matching(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows where the pattern is found anywhere in the column, ignoring case."""
    return df.filter(F.col(column).rlike(f"(?i){pattern}"))


def sort_mixed(
    df: DataFrame, descending: str, ascending: str, tie_break: Sequence[str] = ()
) -> DataFrame:
    return df.orderBy(F.col(descending).desc(), F.col(ascending).asc(), *tie_break)


def top_rows(df: DataFrame, order_by: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def upper_and_double(df: DataFrame, name: str, number: str) -> DataFrame:
    return df.select(
        F.upper(F.col(name)).alias(name), F.col(number).cast("double").alias(number)
    )


def distinct_rows(df: DataFrame) -> DataFrame:
    """Whole-row distinct; copies are merged before the shuffle."""
    return df.dropDuplicates()


def prefix_clashes(
    df: DataFrame, other: DataFrame, keys: Sequence[str], rename: Callable[[str], str]
) -> DataFrame:
    """Rename the non-key columns of ``df`` that ``other`` has too."""
    taken = set(other.columns) - set(keys)
    return df.withColumnsRenamed({c: rename(c) for c in df.columns if c in taken})


def join_without_clash(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    prefix: str,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Inner join; columns of the right side that clash get a prefix."""
    renamed = prefix_clashes(right, left, keys, lambda c: f"{prefix}{c}")
    return spread_join(left, renamed, keys, hot=hot)


def join_distinct(
    left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str
) -> DataFrame:
    """Inner join of two tables after removing duplicate rows from each."""
    return join_without_clash(distinct_rows(left), distinct_rows(right), keys, prefix)


def join_right_suffix(
    dim: DataFrame,
    stage: DataFrame,
    keys: Sequence[str],
    suffix: str = "_new",
    hot: DataFrame | None = None,
) -> DataFrame:
    """``dim RIGHT JOIN stage``: every staged row, clashes of ``stage`` suffixed.

    Written as a left join from the staged side, which is the side that may hold
    hot keys. Columns: keys, then those of the dimension, then the staged ones.
    """
    keys = list(keys)
    staged = prefix_clashes(stage, dim, keys, lambda c: f"{c}{suffix}")
    joined = spread_join(staged, dim, keys, "left", hot=hot)
    dim_columns = [c for c in dim.columns if c not in keys]
    stage_columns = [c for c in staged.columns if c not in keys]
    return joined.select(*keys, *dim_columns, *stage_columns)


def without_match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys), on=list(keys), how="left_anti")


def activity(
    customer: DataFrame,
    rental: DataFrame,
    payment: DataFrame,
    *,
    hot_customers: DataFrame | None = None,
    hot_rentals: DataFrame | None = None,
) -> DataFrame:
    """One row per payment with its rental and customer.

    customer: customer_id, active, first_name, last_name; rental: rental_id,
    customer_id, rental_date; payment: rental_id, amount, payment_date. The many
    side leads each join, so its hot keys can be cut into pieces.
    """
    named = customer.select(
        "customer_id",
        "active",
        F.concat("first_name", F.lit(" "), "last_name").alias("full_name"),
    )
    paid = spread_join(
        payment.select("rental_id", "amount", "payment_date"),
        rental.select("rental_id", "customer_id", "rental_date"),
        ["rental_id"],
        hot=hot_rentals,
    )
    return spread_join(paid, named, ["customer_id"], hot=hot_customers).select(
        "customer_id", "active", "full_name", "rental_id", "rental_date", "amount", "payment_date"
    )
