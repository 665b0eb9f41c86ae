"""Loads merged into keyed tables with one join: both sides hold a key at most once.

``warehouse`` has the same loads for tables whose keys may repeat. Here the rows to load
are made unique by an aggregate on the key, and the join finds them dealt out by the
key already, so each side is read and shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.warehouse import HISTORY_COLUMNS, NEW, has_key, one_per_key

_OLD_HERE, _NEW_HERE = "_old_here", "_new_here"


def _matched(
    target: DataFrame, rows: DataFrame, keys: Sequence[str], how: str
) -> DataFrame:
    """Rows of both sides by key; those to load with the suffix ``_new``, and where a row is from."""
    renamed = rows.select(
        *keys, *[F.col(c).alias(f"{c}{NEW}") for c in rows.columns if c not in keys],
        F.lit(True).alias(_NEW_HERE),
    )
    return target.withColumn(_OLD_HERE, F.lit(True)).join(renamed, list(keys), how)


def merge_rows(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    *,
    columns: Sequence[str] | None = None,
    insert: bool = True,
    order_by: str | None = None,
    first: bool = False,
) -> DataFrame:
    """``target`` after a load of ``source``.

    Rows whose key is in the source take its ``columns``, by default all, nulls too; an
    empty list keeps them as they are. With ``insert`` rows of other keys are added.
    Different source rows of a key are an error, unless ``order_by`` says which is the
    last (``first``: the first). Null keys match nothing: such rows of the target stay,
    and such rows of the source are added with ``insert``. No key may repeat in ``target``.
    """
    keys = list(keys)
    columns = [c for c in target.columns if c not in keys] if columns is None else list(columns)
    wanted = [c for c in target.columns if insert or c in keys or c in columns]
    rows = one_per_key(source.select(*wanted, *_order(order_by, wanted)), keys, order_by, first)
    joined = _matched(target, rows, keys, "full_outer" if insert else "left_outer")

    def value(c: str) -> Column:
        if c in keys or c not in wanted:
            return F.col(c)
        takes = F.col(_NEW_HERE) if c in columns else F.col(_OLD_HERE).isNull()
        return F.when(takes, F.col(f"{c}{NEW}")).otherwise(F.col(c)).alias(c)

    after = joined.select(*[value(c) for c in target.columns])
    if insert:
        after = after.unionByName(source.where(~has_key(keys)).select(*target.columns))
    return after


def _order(order_by: str | None, columns: Sequence[str]) -> list[str]:
    return [order_by] if order_by is not None and order_by not in columns else []


def remove_rows(target: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """``target`` without the rows whose key is among ``values``; rows with a null key stay."""
    return target.join(values.select(key), key, "left_anti")


def merge_history(
    dim: DataFrame,
    stage: DataFrame,
    now: Column,
    *,
    key: str = "uuid",
    compare: Sequence[str] | None = None,
) -> DataFrame:
    """A type 2 dimension after a load: current rows of staged keys end, new versions come.

    Only current rows are joined, and a joined row gives the ended and the new version.
    With ``compare`` a current row that has the staged values in these columns stays as
    it is. New versions have a null ``id``. A key with two current rows, or two different
    staged rows, is an error. Staged rows without a key are added each.
    """
    is_current = F.coalesce(F.col("rowIsCurrent"), F.lit(False)) & F.col(key).isNotNull()
    current = one_per_key(dim.where(is_current), [key])
    taken = [c for c in dim.columns if c in stage.columns and c not in (*HISTORY_COLUMNS, key)]
    joined = _matched(current, one_per_key(stage.select(key, *taken), [key]), [key], "full_outer")
    differs = F.lit(True)
    if compare is not None:
        differs = F.lit(False)
        for c in compare:
            differs = differs | ~F.col(c).eqNullSafe(F.col(f"{c}{NEW}"))
    old, new = F.col(_OLD_HERE).isNotNull(), F.col(_NEW_HERE).isNotNull()
    ends = old & new & differs

    def version(value) -> Column:
        return F.struct(*[value(f.name).cast(f.dataType).alias(f.name) for f in dim.schema.fields])

    def before(c: str) -> Column:
        ended = {"rowIsCurrent": F.lit(False), "rowEndDate": now}
        return F.when(ends, ended[c]).otherwise(F.col(c)) if c in ended else F.col(c)

    def added(c: str, suffix: str = NEW) -> Column:
        if c == "rowIsCurrent":
            return F.lit(True)
        return F.col(c) if c == key else F.col(f"{c}{suffix}") if c in taken else F.lit(None)

    versions = F.array(
        F.when(old, version(before)), F.when(new & (ends | ~old), version(added))
    )
    merged = joined.select(F.explode(F.array_compact(versions)).alias("_row")).select("_row.*")
    unkeyed = stage.where(F.col(key).isNull()).select(version(lambda c: added(c, "")).alias("_row"))
    return dim.where(~is_current).unionByName(merged).unionByName(unkeyed.select("_row.*"))
