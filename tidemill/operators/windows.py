"""Window reports, planned so that no task holds a whole hot group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.columns import mean_of, percent_of
from tidemill.operators.ranges import CARRIED, RANGE, with_carried_rows
from tidemill.operators.skew import spread_join


def share_of_group(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    name: str = "percent_in_month",
    *,
    digits: int = 2,
    hot: DataFrame | None = None,
    spread_by: Sequence[str] | None = None,
) -> DataFrame:
    """Every row's percentage of its group's total; null where the total is zero.

    Without ``hot`` groups (see ``hot_keys``) this is a window: one scan and one
    shuffle. With them a window would put a hot group into one task, so the
    totals are combined before their shuffle and joined back in pieces.
    """
    if hot is None:
        joined = df.withColumn("_total", F.sum(value).over(Window.partitionBy(*keys)))
    else:
        totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
        joined = spread_join(
            df, totals, keys, "left", hot=hot, spread_by=spread_by, null_safe=True
        )
    return joined.withColumn(name, percent_of(F.col(value), F.col("_total"), digits)).drop("_total")


def moving_average_rows(
    df: DataFrame,
    value: str,
    order_by: Sequence[str],
    *,
    partition_by: Sequence[str] = (),
    preceding: int = 7,
    name: str = "moving_avg",
    min_ranges: int = 1,
) -> DataFrame:
    """Average over the current row and the ``preceding`` rows before it.

    ``order_by`` should end in a unique column, or ties are in no fixed order.
    The rows are cut into ranges of the whole key (partition and order columns),
    so neither the frame over the whole table nor a hot partition is one task.
    ``df`` is read several times, so it should be a table or ``shared.keep`` of
    something that costs more than a scan.
    """
    whole_key = [*partition_by, *order_by]
    ranged = with_carried_rows(df, whole_key, value, preceding, min_ranges)
    frame = (
        Window.partitionBy(RANGE, *partition_by).orderBy(*order_by).rowsBetween(-preceding, 0)
    )
    average = mean_of(F.sum(value).over(frame), F.count(value).over(frame))
    return ranged.withColumn(name, average).where(~F.col(CARRIED)).drop(RANGE, CARRIED)


def moving_average_days(
    df: DataFrame,
    value: str,
    moment: str,
    *,
    partition_by: Sequence[str] = (),
    days: int = 7,
    name: str = "moving_avg",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Average over the rows of the current day and the ``days - 1`` days before.

    Rows are first combined to one per day, so the frame runs over days. Without
    partition columns the daily table is broadcast: a DATE has fewer than 3.7
    million values (years 1 to 9999), which bounds it whatever the input.
    ``hot`` are hot keys over the partition columns and ``_day``.
    """
    dated = df.withColumn("_day", F.to_date(moment))
    keys = [*partition_by, "_day"]
    daily = dated.groupBy(*keys).agg(F.sum(value).alias("_sum"), F.count(value).alias("_count"))
    frame = Window.partitionBy(*partition_by) if partition_by else Window
    frame = frame.orderBy(F.unix_date("_day")).rangeBetween(1 - days, 0)
    averages = daily.select(
        *keys, mean_of(F.sum("_sum").over(frame), F.sum("_count").over(frame)).alias(name)
    )
    if not partition_by:
        averages = F.broadcast(averages)
        hot = None
    return spread_join(dated, averages, keys, "left", hot=hot, null_safe=True).drop("_day")


def activity_recency(customer: DataFrame, rental: DataFrame, payment: DataFrame) -> DataFrame:
    """Per customer: days between first and last rental, and mean payment.

    Equals DISTINCT over per-customer windows on the joined rows of ``activity``,
    without making those rows: payments are combined per rental and rentals per
    customer before each join, so no join meets a hot customer or rental.

    customer: customer_id, first_name, last_name; rental: rental_id, customer_id,
    rental_date; payment: rental_id, amount.
    """
    per_rental = payment.groupBy("rental_id").agg(
        F.sum("amount").alias("_sum"), F.count("amount").alias("_count")
    )
    per_customer = (
        rental.select("rental_id", "customer_id", "rental_date")
        .join(per_rental, "rental_id")
        .groupBy("customer_id")
        .agg(
            F.max("rental_date").alias("_latest"),
            F.min("rental_date").alias("_earliest"),
            F.sum("_sum").alias("_sum"),
            F.sum("_count").alias("_count"),
        )
    )
    named = customer.select(
        "customer_id", F.concat("first_name", F.lit(" "), "last_name").alias("full_name")
    ).distinct()
    return named.join(per_customer, "customer_id").select(
        "customer_id",
        "full_name",
        F.datediff("_latest", "_earliest").alias("recency"),
        mean_of(F.col("_sum"), F.col("_count")).alias("avg_amount"),
    )
