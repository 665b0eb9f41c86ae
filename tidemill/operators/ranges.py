"""Cut a table into ordered ranges of similar size, for frames without a partition.

A window without PARTITION BY runs in one task. Here the rows are cut at sampled
bounds of the whole sort key, so that even a single hot day is cut, and the rows
a frame needs from before its range are carried over exactly.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE = "_range"
CARRIED = "_carried"
ROWS_PER_RANGE = 200_000
MAX_RANGES = 16_384
SAMPLES_PER_RANGE = 60
JSON_RULES = {
    "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
}


@dataclass(frozen=True)
class Ranges:
    """Where a sorted table is cut. Keys are JSON objects.

    ``bounds`` are the lowest keys of ranges 1..n-1. ``sampled`` lists the
    sampled keys of each of the n ranges; they are keys of rows of the table.
    """

    bounds: list[str]
    sampled: list[list[str]]

    def late_keys(self, rows: int) -> list[str]:
        """For each range a key with at least ``rows`` rows of the range at or above it.

        It is the key of the sampled row that many from the end, or null, which
        stands for the whole range, where fewer were sampled.
        """
        return [keys[-rows] if len(keys) >= rows else "null" for keys in self.sampled]


def find_ranges(
    df: DataFrame, order_by: Sequence[str], min_ranges: int = 1, seed: int = 17
) -> Ranges:
    """Cut points of about ``ROWS_PER_RANGE`` rows, from a sample of the sort key.

    The sample is at most about ``MAX_RANGES * SAMPLES_PER_RANGE`` keys, whatever
    the size of the table. It decides on balance only, not on results.
    """
    keys = df.select(*order_by)
    total = keys.count()
    ranges = max(min_ranges, math.ceil(total / ROWS_PER_RANGE))
    ranges = min(ranges, MAX_RANGES, total)
    if ranges <= 1:
        return Ranges([], [[]])
    wanted = ranges * SAMPLES_PER_RANGE
    sample = keys if wanted >= total else keys.sample(wanted / total, seed=seed)
    as_json = F.to_json(_key(order_by), JSON_RULES)
    ordered = [row[0] for row in sample.orderBy(*order_by).select(as_json).collect()]
    starts = {ordered[i * len(ordered) // ranges] for i in range(1, ranges)} if ordered else set()
    bounds: list[str] = []
    sampled: list[list[str]] = [[]]
    for key in ordered:
        if key in starts and (not bounds or bounds[-1] != key):
            bounds.append(key)
            sampled.append([])
        sampled[-1].append(key)
    return Ranges(bounds, sampled)


def with_range(df: DataFrame, order_by: Sequence[str], bounds: Sequence[str]) -> DataFrame:
    """Add the range number: how many bounds are at or below the row's key.

    A binary search with one projection per step, which stays inside generated
    code. Each step has a constant with just the bounds it may look at, so that
    the constants together are as large as the bounds.
    """
    ranged = df.withColumn(RANGE, F.lit(0))
    found = F.col(RANGE)
    for power in reversed(range(len(bounds).bit_length())):
        step = 1 << power
        pivots = _keys_array(df, order_by, bounds[step - 1 :: 2 * step])
        # Null behind the last bound, so the search stays in front of it.
        at_or_below = F.get(pivots, F.shiftright(found, power + 1)) <= _key(order_by)
        ranged = ranged.withColumn(RANGE, F.when(at_or_below, found + step).otherwise(found))
    # The added zero is not deterministic to the optimizer, which would otherwise copy
    # the search into every filter on the range, doubling it at each step.
    return ranged.withColumn(RANGE, found + F.spark_partition_id() * 0)


def _key(order_by: Sequence[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order_by)])


def _keys_array(df: DataFrame, order_by: Sequence[str], keys: Sequence[str]) -> Column:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    key = T.StructType([T.StructField(f"k{i}", kinds[c]) for i, c in enumerate(order_by)])
    return F.from_json(F.lit(f"[{','.join(keys)}]"), T.ArrayType(key), JSON_RULES)


def with_carried_rows(
    df: DataFrame,
    order_by: Sequence[str],
    value: str,
    preceding: int,
    min_ranges: int = 1,
) -> DataFrame:
    """``df`` with a range number, plus the rows each range needs from before it.

    Every range gets copies, marked ``_carried``, of the ``preceding`` rows that
    come just before it in the whole order. Only the last rows of each range are
    gathered for this: at most ``MAX_RANGES * preceding`` rows.
    """
    columns = list(dict.fromkeys([*order_by, value]))
    ranges = find_ranges(df, order_by, min_ranges)
    ranged = with_range(df, order_by, ranges.bounds).withColumn(CARRIED, F.lit(False))
    if not ranges.bounds:
        return ranged
    late = F.get(_keys_array(df, order_by, ranges.late_keys(preceding)), F.col(RANGE))
    latest_first = Window.partitionBy(RANGE).orderBy(*[F.desc(c) for c in order_by])
    tails = (
        ranged.select(RANGE, *columns)
        .where(F.coalesce(_key(order_by) >= late, F.lit(True)))
        .withColumn("_rank", F.row_number().over(latest_first))
        .where(F.col("_rank") <= preceding)
        .groupBy(RANGE)
        .agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_tail"))
    )
    # One row per range from here on. Every range listed has at least one row, so
    # the last `preceding` ranges hold the last `preceding` rows.
    before = Window.orderBy(RANGE).rowsBetween(-preceding, -1)
    carried = (
        tails.withColumn("_before", F.flatten(F.collect_list("_tail").over(before)))
        .select(
            RANGE,
            F.explode(
                F.slice(
                    "_before",
                    F.greatest(F.size("_before") - preceding + 1, F.lit(1)),
                    F.lit(preceding),
                )
            ).alias("_row"),
        )
        .select(RANGE, "_row.*")
        .withColumn(CARRIED, F.lit(True))
    )
    return ranged.unionByName(carried, allowMissingColumns=True)
