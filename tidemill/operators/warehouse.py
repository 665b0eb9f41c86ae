"""Warehouse loads: dimension changes, upserts, keyed updates and deletes.

Tables go in and come out as DataFrames; ``sources.catalog`` writes results. The
joins put the large or possibly skewed side first, so AQE can split it.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.relational import (
    fold_all,
    fold_any,
    join_right_suffix,
    without_match,
)
from tidemill.operators.skew import hot_keys, spread_join

NEW = "_new"

# Columns that carry the history of a dimension row, and load modes.
HISTORY_COLUMNS = ("id", "rowIsCurrent", "rowEndDate")
STAGE_MODE = "stage"
SCD1_MODE = "scd-type1"

CHANGE, CHANGED, INSERTED, UPDATED = "change", "changed", "inserted", "updated"


def with_load_time(df: DataFrame, now: Column | None = None) -> DataFrame:
    return df.withColumn("modifiedDate", F.current_timestamp() if now is None else now)


# -- type 1 -----------------------------------------------------------------


def compared_columns(columns: Sequence[str], special: Sequence[str]) -> list[str]:
    return [c for c in columns if c not in special]


def classified(
    joined: DataFrame,
    key: str,
    compared: Sequence[str],
    *,
    null_safe: bool = False,
    known: str | None = None,
) -> DataFrame:
    """What each staged row of a join is to the dimension, decided once per row.

    ``joined`` has the dimension's columns and, with the suffix ``_new``, the staged
    ones. The result has the key, the staged values, ``changed``, the names of the
    columns whose value is another one, and ``change``: inserted, updated or null. A
    change to null counts with ``null_safe`` only. A row is inserted if the dimension's
    column ``known`` is null, or without ``known`` if all compared ones are.
    """

    def differs(c: str) -> Column:
        old, new = F.col(c), F.col(f"{c}{NEW}")
        # a null on either side leaves the comparison open: then a value that is staged is news
        return ~old.eqNullSafe(new) if null_safe else F.coalesce(old != new, new.isNotNull())

    names = F.array(*[F.when(differs(c), F.lit(c)) for c in compared]).cast("array<string>")
    there = [known] if known is not None else list(compared)
    held = F.array_max(F.array(*[F.col(c).isNotNull() for c in there]))
    marked = joined.withColumns({CHANGED: F.array_compact(names), "_held": held})
    kind = F.when(~F.col("_held"), INSERTED).when(F.size(CHANGED) > 0, UPDATED)
    return marked.select(
        key, *[F.col(f"{c}{NEW}").alias(c) for c in compared], CHANGED, kind.alias(CHANGE)
    )


def scd1_updated_rows(
    joined: DataFrame, columns: Sequence[str], special: Sequence[str], null_safe: bool = False
) -> DataFrame:
    """Staged rows where some compared column differs from the old value, new rows among them."""
    compared = compared_columns(columns, special)
    rows = classified(joined, special[0], compared, null_safe=null_safe)
    return rows.filter(F.size(CHANGED) > 0).drop(CHANGE, CHANGED)


def scd1_new_rows(
    joined: DataFrame,
    columns: Sequence[str],
    special: Sequence[str],
    known: str | None = None,
) -> DataFrame:
    """Staged rows that the dimension lacks.

    With ``known``, a column that is null only for rows without a match, a matched row
    whose attributes are all null is not taken for a new one.
    """
    rows = classified(joined, special[0], compared_columns(columns, special), known=known)
    return rows.filter(F.col(CHANGE) == INSERTED).drop(CHANGE, CHANGED)


def scd1_changes(
    dim: DataFrame,
    stage: DataFrame,
    special: Sequence[str],
    *,
    placeholder_rows: int = 0,
    null_safe: bool = False,
    by_key: bool = False,
) -> DataFrame:
    """Staged rows to load, with a column ``change``: inserted or updated.

    ``special[0]`` is the key of the dimension; rows of it that repeat a key and differ
    raise. No column of ``special`` is compared, and all other columns have to be
    staged. On request a dimension with at most ``placeholder_rows`` rows is taken as
    empty, so that every staged row is an insert. One join decides on both kinds.
    """
    key = special[0]
    compared = compared_columns(dim.columns, special)
    absent = [c for c in compared if c not in stage.columns]
    if absent:
        raise ValueError(f"stage lacks the dimension columns {absent}")
    staged = stage.select(key, *compared)
    if placeholder_rows and dim.limit(placeholder_rows + 1).count() <= placeholder_rows:
        return staged.select(F.lit(INSERTED).alias(CHANGE), "*")
    old = one_per_key(dim.select(key, *compared), [key]).withColumn("_known", F.lit(True))
    joined = join_right_suffix(old, staged, [key], NEW, hot=hot_keys(staged, [key]))
    rows = classified(
        joined, key, compared, null_safe=null_safe, known="_known" if by_key else None
    )
    return rows.filter(F.col(CHANGE).isNotNull()).select(CHANGE, key, *compared)


def scd1_find(
    dim: DataFrame, stage: DataFrame, special: Sequence[str], **options
) -> tuple[DataFrame, DataFrame]:
    """``scd1_changes`` as two frames: (updated, inserted)."""
    changes = scd1_changes(dim, stage, special, **options)
    updated, inserted = (
        changes.filter(F.col(CHANGE) == kind).drop(CHANGE) for kind in (UPDATED, INSERTED)
    )
    return updated, inserted


# -- type 2 -----------------------------------------------------------------


def _replaced_keys(
    dim: DataFrame, stage: DataFrame, key: str, compare: Sequence[str] | None
) -> DataFrame:
    """Staged keys whose current dimension row ends; a key may come twice."""
    if compare is None:
        return stage.select(key)
    current = dim.filter(F.col("rowIsCurrent")).select(key, *compare)
    staged = stage.select(key, *[F.col(c).alias(f"{c}{NEW}") for c in compare])
    differs = fold_any([~F.col(c).eqNullSafe(F.col(f"{c}{NEW}")) for c in compare])
    return current.join(staged, on=key).filter(differs).select(key)


def scd2_close(
    dim: DataFrame,
    stage: DataFrame,
    now: Column,
    *,
    key: str = "uuid",
    columns: Sequence[str] = HISTORY_COLUMNS,
    compare: Sequence[str] | None = None,
) -> DataFrame:
    """The current rows of staged keys, marked as ended at ``now``.

    Every staged key ends its current row; with ``compare`` only where one of
    these columns differs. Apply the result with ``keyed_update`` on ``id``.
    """
    replaced = _replaced_keys(dim, stage, key, compare)
    return (
        dim.filter(F.col("rowIsCurrent"))
        .join(replaced, on=key, how="left_semi")
        .withColumns({"rowIsCurrent": F.lit(False), "rowEndDate": now})
        .select(*columns)
    )


def scd2_apply(
    dim: DataFrame,
    stage: DataFrame,
    now: Column,
    *,
    key: str = "uuid",
    compare: Sequence[str] | None = None,
) -> DataFrame:
    """The dimension after a load: old versions ended, new versions added.

    New versions hold the staged columns and a null ``id``, which the target
    table assigns. A staged key with an unchanged current row adds nothing.
    """
    replaced = _replaced_keys(dim, stage, key, compare).distinct()
    ends = F.col("_hit") & F.col("rowIsCurrent")
    ended = {"rowIsCurrent": F.lit(False), "rowEndDate": now}
    marked = spread_join(
        dim, replaced.withColumn("_hit", F.lit(True)), [key], "left", hot=hot_keys(dim, [key])
    )
    after = marked.select(
        *[
            F.when(ends, ended[c]).otherwise(F.col(c)).alias(c) if c in ended else F.col(c)
            for c in dim.columns
        ]
    )
    still_current = after.filter(F.col("rowIsCurrent"))
    types = {f.name: f.dataType for f in dim.schema.fields}

    def added_column(c: str) -> Column:
        if c == "rowIsCurrent":
            value = F.lit(True)
        elif c in stage.columns and c not in HISTORY_COLUMNS:
            value = F.col(c)
        else:
            value = F.lit(None)
        return value.cast(types[c]).alias(c)

    added = without_match(one_per_key(stage, [key]), still_current, [key]).unionByName(
        stage.filter(~has_key([key]))
    )
    return after.unionByName(added.select(*[added_column(c) for c in dim.columns]))


# -- keyed writes -----------------------------------------------------------


def has_key(keys: Sequence[str]) -> Column:
    return fold_all([F.col(k).isNotNull() for k in keys])


def one_per_key(
    df: DataFrame, keys: Sequence[str], latest_by: str | None = None, first: bool = False
) -> DataFrame:
    """At most one row per key, of the rows whose key is not null.

    With ``latest_by`` the row with its highest (``first``: lowest) value stays.
    Without it equal copies are one row, and rows of a key that differ raise an error
    when they are read. Runs as a partial aggregate, so repeated rows of a hot key are
    merged before the shuffle.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest) if rest else F.struct(F.lit(1).alias("_"))
    grouped = df.filter(has_key(keys)).groupBy(*keys)
    if latest_by is None:
        key_text = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
        repeated = F.raise_error(F.concat(F.lit("repeated key: "), key_text)).cast("boolean")
        content = F.xxhash64(*rest) if rest else F.lit(0)
        merged = grouped.agg(
            F.first(row).alias("_row"), F.min(content).alias("_low"), F.max(content).alias("_high")
        ).filter(F.when(F.col("_low") != F.col("_high"), repeated).otherwise(True))
    else:
        pick = F.min_by if first else F.max_by
        merged = grouped.agg(pick(row, F.col(latest_by)).alias("_row"))
    return merged.select(*[F.col(k) if k in keys else F.col(f"_row.{k}") for k in df.columns])


def upsert(
    target: DataFrame, source: DataFrame, keys: Sequence[str], latest_by: str | None = None
) -> DataFrame:
    """Source rows replace target rows with the same key; other rows stay.

    Null keys conflict with nothing. Different rows of a key in the source are an error
    unless ``latest_by`` says which row is the last. A small source is broadcast
    to the target, which then is not shuffled.
    """
    rows = one_per_key(source, keys, latest_by).select(*target.columns)
    unkeyed = source.filter(~has_key(keys)).select(*target.columns)
    return without_match(target, source, keys).unionByName(rows).unionByName(unkeyed)


def insert_if_absent(
    target: DataFrame, source: DataFrame, keys: Sequence[str], first_by: str | None = None
) -> DataFrame:
    """Source rows whose key the target lacks are added; conflicts are skipped.

    The target is first cut to the keys of the source, so that a small source
    can be broadcast to a large target instead of the target being shuffled.
    """
    rows = one_per_key(source, keys, first_by, first=True).select(*target.columns)
    unkeyed = source.filter(~has_key(keys)).select(*target.columns)
    taken = target.select(*keys).join(source.select(*keys), on=list(keys), how="left_semi")
    return target.unionByName(without_match(rows, taken, keys)).unionByName(unkeyed)


def keyed_update(
    target: DataFrame, source: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Set ``columns`` of the target rows whose key is in the source.

    A null in the source is written; keys only in the source are ignored. The
    key need not be unique in the target.
    """
    keys = list(keys)
    values = one_per_key(source.select(*keys, *columns), keys).select(
        *keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"{c}{NEW}") for c in columns]
    )
    joined = spread_join(target, values, keys, "left", hot=hot_keys(target, keys))
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"{c}{NEW}")).otherwise(F.col(c)).alias(c)
            if c in columns
            else F.col(c)
            for c in target.columns
        ]
    )


def keyed_delete(target: DataFrame, key: str, values: DataFrame | Sequence[Any]) -> DataFrame:
    """Rows whose key is not among ``values``; rows with a null key stay."""
    if not isinstance(values, DataFrame):
        key_type = target.schema[key].dataType.simpleString()
        values = target.sparkSession.createDataFrame(
            [(v,) for v in values], f"`{key}` {key_type}"
        )
    return without_match(target, values, [key])


def load_by_mode(
    mode: str, target: DataFrame, source: DataFrame, keys: Sequence[str], order_by: str | None = None
) -> DataFrame:
    if mode == STAGE_MODE:
        return insert_if_absent(target, source, keys, order_by)
    if mode == SCD1_MODE:
        return upsert(target, source, keys, order_by)
    raise KeyError(f"unknown load mode {mode!r}: use {STAGE_MODE!r} or {SCD1_MODE!r}")
