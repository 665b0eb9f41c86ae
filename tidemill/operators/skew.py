"""Joins and groupings that stay balanced when one key holds much of a table.

AQE splits a skewed shuffle only under a plain sort-merge join. The helpers here
cover the other cases: they look for hot keys in a sample and give each hot key
several *pieces*, so its rows go to several tasks. Which keys are called hot
changes only the balance of the work, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.shared import keep

PIECE = "_piece"
PIECES = "_pieces"
SAMPLES_PER_SHARE = 100
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class SkewRule:
    """When a key is hot: it holds at least ``share`` of the rows.

    By default the share is that of an average shuffle partition, but at most
    1/200. At most ``1 / share`` keys can be hot, which bounds what is broadcast
    and what the driver holds. Tables under ``min_rows`` are left alone.
    """

    min_rows: int = 5_000_000
    share: float | None = None
    seed: int = 17

    def share_for(self, spark: SparkSession) -> float:
        if self.share is not None:
            return self.share
        return 1 / max(200, int(spark.conf.get("spark.sql.shuffle.partitions")))


DEFAULT_RULE = SkewRule()


def hot_keys(df: DataFrame, keys: Sequence[str], rule: SkewRule = DEFAULT_RULE) -> DataFrame | None:
    """Keys that hold a large share of ``df``, with the number of pieces for each.

    Reads only the key columns, and shuffles counts of a sample. ``df`` should
    be a table scan or something as cheap. Returns None when no key is hot.
    """
    keyed = df.select(*keys)
    total = keyed.count()
    if total < rule.min_rows:
        return None
    share = rule.share_for(df.sparkSession)
    fraction = min(1.0, SAMPLES_PER_SHARE / share / total)
    sample = keyed if fraction == 1.0 else keyed.sample(fraction, seed=rule.seed)
    threshold = max(2, math.ceil(share * fraction * total))
    counted = (
        sample.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") >= threshold)
        .withColumn(PIECES, F.ceil(F.col("_rows") / threshold).cast("int") + 1)
        .drop("_rows")
    )
    # At most fraction * total / threshold <= 1 / share rows reach the driver.
    rows = counted.collect()
    if not rows:
        return None
    return F.broadcast(df.sparkSession.createDataFrame(rows, counted.schema))


def with_piece(
    df: DataFrame, keys: Sequence[str], hot: DataFrame | None, spread_by: Sequence[str]
) -> DataFrame:
    """Add the piece number: 0, or a hash of ``spread_by`` for rows of a hot key.

    The hash depends on the row alone, so a task that runs again after a lost
    executor places every row where it was before.
    """
    if hot is None:
        return df.withColumn(PIECE, F.lit(0).cast("bigint"))
    spread = F.pmod(F.xxhash64(*spread_by), F.col(PIECES).cast("bigint"))
    marked = _join_null_safe(df, hot, keys, "left")
    return marked.withColumn(
        PIECE, F.when(F.col(PIECES).isNull(), F.lit(0).cast("bigint")).otherwise(spread)
    ).drop(PIECES)


def spread_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    *,
    hot: DataFrame | None = None,
    spread_by: Sequence[str] | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """``left JOIN right USING (keys)`` with hot keys of ``left`` cut into pieces.

    The matching rows of ``right`` are repeated once per piece; every row of
    ``left`` is in exactly one piece, so inner, left, left_semi and left_anti
    joins give the same rows as without pieces. ``spread_by`` are columns that
    tell the rows of a hot key apart, by default all; whole-row copies share a
    piece, which AQE may still split. With ``null_safe`` null keys match each
    other, as they do in a grouping.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"spread_join does not support {how}")
    keys = list(keys)
    if hot is None:
        if null_safe:
            return _join_null_safe(left, right, keys, how)
        return left.join(right, on=keys, how=how)
    spread = list(spread_by) if spread_by else list(left.columns)
    left_pieces = with_piece(left, keys, hot, spread)
    right_pieces = (
        _join_null_safe(right, hot, keys, "left")
        .withColumn(
            PIECE,
            F.explode(
                F.sequence(F.lit(0).cast("bigint"), F.coalesce(PIECES, F.lit(1)).cast("bigint") - 1)
            ),
        )
        .drop(PIECES)
    )
    on = [*keys, PIECE]
    if null_safe:
        return _join_null_safe(left_pieces, right_pieces, on, how).drop(PIECE)
    return left_pieces.join(right_pieces, on=on, how=how).drop(PIECE)


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """USING-style join where null keys match; keeps the keys of ``left``."""
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"_right_{key}")
    condition: Column | None = None
    for key in keys:
        equal = F.col(key).eqNullSafe(F.col(f"_right_{key}"))
        condition = equal if condition is None else condition & equal
    return left.join(renamed, on=condition, how=how).drop(*[f"_right_{key}" for key in keys])
