"""Keyed catalog tables whose loads appear at once, or not at all.

A keyed table is a view of one version. A version is an external table with a
partition for each value of an expression over the key. A load reads the partitions
that its keys fall into, writes them anew to a folder of its own, makes the next
version of the new partitions and of all others where they lie, and replaces the
view. Until then readers see the old rows, and a load that is killed leaves them; what
it wrote is removed by the next load. One load at a time may run on a table.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import merge
from tidemill.operators.warehouse import SCD1_MODE, STAGE_MODE
from tidemill.shared import matching_paths, new_folder, remove_folder, shared_root
from tidemill.sources.catalog import balanced_writer, require_key

PART = "part_id"
#: Partitions that one statement adds.
ADDED_AT_ONCE = 500
#: Versions that stay readable after the one that replaced them.
KEPT_VERSIONS = 1

Change = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class KeyedTable:
    """What a keyed table's view says of it."""

    name: str
    keys: tuple[str, ...]
    part: str
    folder: str
    versions: tuple[str, ...]

    @property
    def current(self) -> str:
        return self.versions[-1]

    def part_of_key(self) -> Column:
        return F.coalesce(F.expr(self.part).cast("bigint"), F.lit(-1)).alias(PART)


def hashed_part(keys: Sequence[str], parts: int) -> str:
    """An expression that deals keys to so many partitions."""
    return f"pmod(xxhash64({', '.join(keys)}), {parts})"


def create_keyed(
    df: DataFrame,
    name: str,
    keys: Sequence[str],
    part: str,
    folder: str | None = None,
    *,
    unique: bool = True,
) -> KeyedTable:
    """Store ``df`` as the keyed table ``name``.

    ``part`` is an SQL expression over key columns that gives a whole number: the
    fewer of its values a load has, the less it rewrites. A key that is null or
    repeated is an error unless ``unique`` is false.
    """
    spark = df.sparkSession
    if unique:
        require_key(df, keys)
    folder = (folder or f"{shared_root(spark)}/{name.replace('.', '/')}-{uuid.uuid4().hex}").rstrip("/")
    table = KeyedTable(name, tuple(keys), part, folder, ())
    return _next_version(spark, table, df, {})


def keyed_table(spark: SparkSession, name: str) -> KeyedTable:
    """The keyed table behind a view."""
    told = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    if "tidemill.part" not in told:
        raise ValueError(f"{name} is no keyed table")
    return KeyedTable(
        name, tuple(told["tidemill.keys"].split(",")), told["tidemill.part"],
        told["tidemill.folder"], tuple(told["tidemill.versions"].split(",")),
    )


def _places(spark: SparkSession, version: str) -> dict[int, str]:
    """The folder of each partition of a version; files are listed, not read."""
    found = {}
    for file in spark.table(version).inputFiles():
        place, part = re.fullmatch(rf"(.*/{PART}=(-?\d+))/[^/]*", unquote(file)).groups()
        found[int(part)] = place
    return found


def _added(version: str, places: dict[int, str]) -> Iterator[str]:
    """Statements that add partitions to a version."""
    listed = sorted(places.items())
    for start in range(0, len(listed), ADDED_AT_ONCE):
        specs = " ".join(
            f"PARTITION ({PART} = {part}) LOCATION '{place}'"
            for part, place in listed[start : start + ADDED_AT_ONCE]
        )
        yield f"ALTER TABLE {version} ADD {specs}"


def _next_version(
    spark: SparkSession, table: KeyedTable, rows: DataFrame, places: dict[int, str]
) -> KeyedTable:
    """Write ``rows`` as partitions of a version that has those at ``places`` too, and switch to it."""
    number = uuid.uuid4().hex[:12]
    version, folder = f"{table.name}__{number}", f"{table.folder}/{number}"
    dealt = rows.select("*", table.part_of_key())
    balanced_writer(dealt, [PART]).parquet(folder)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    spark.sql(
        f"CREATE TABLE {version} ({kinds}) USING parquet PARTITIONED BY ({PART}) LOCATION '{folder}'"
    )
    written = matching_paths(spark, f"{folder}/{PART}=*")
    places = places | {int(path.rsplit("=", 1)[1]): path for path in written}
    for statement in _added(version, places):
        spark.sql(statement)
    versions = (*table.versions, version)[-1 - KEPT_VERSIONS :]
    after = replace(table, versions=versions)
    _switch(spark, after, rows.columns)
    _remove_unused(spark, after, [v for v in table.versions if v not in versions])
    return after


def _switch(spark: SparkSession, table: KeyedTable, columns: Sequence[str]) -> None:
    """Make the last version the table: one change of the catalog."""
    told = {
        "keys": ",".join(table.keys), "part": table.part, "folder": table.folder,
        "versions": ",".join(table.versions),
    }
    properties = ", ".join(
        "'tidemill.{}' = '{}'".format(k, v.replace("\\", "\\\\").replace("'", "\\'")) for k, v in told.items()
    )
    listed = ", ".join(f"`{c}`" for c in columns)
    spark.sql(
        f"CREATE OR REPLACE VIEW {table.name} TBLPROPERTIES ({properties}) "
        f"AS SELECT {listed} FROM {table.current}"
    )


def _remove_unused(spark: SparkSession, table: KeyedTable, versions: Sequence[str]) -> None:
    """Drop versions, and the folders of partitions that only they had."""
    used = {place for v in table.versions for place in _places(spark, v).values()}
    for version in versions:
        places = set(_places(spark, version).values())
        spark.sql(f"DROP TABLE {version}")
        for place in places - used:
            remove_folder(spark, place)


def _remove_leftovers(spark: SparkSession, table: KeyedTable) -> None:
    """Drop versions that no view names: those of loads that were killed."""
    database, _, short = table.name.rpartition(".")
    where = f" IN {database}" if database else ""
    for row in spark.sql(f"SHOW TABLES{where} LIKE '{short}__*'").collect():
        version = f"{database}.{row['tableName']}" if database else row["tableName"]
        if version not in table.versions:
            spark.sql(f"DROP TABLE {version}")
            remove_folder(spark, f"{table.folder}/{version.rsplit('__', 1)[1]}")


def touched_rows(spark: SparkSession, table: KeyedTable, parts: Sequence[int]) -> DataFrame:
    """Rows of some partitions of the current version; others are not read."""
    return spark.table(table.current).where(F.col(PART).isin(list(parts))).drop(PART)


def load_keyed(spark: SparkSession, name: str, source: DataFrame, change: Change) -> KeyedTable:
    """Rewrite the partitions that the keys of ``source`` fall into as ``change(rows, source)``.

    The source is read once and kept in the shared folder. ``change`` gets the rows of
    the touched partitions, and has to leave their keys in them. A load without rows
    changes nothing.
    """
    table = keyed_table(spark, name)
    _remove_leftovers(spark, table)
    scratch = new_folder(spark, "load")
    source.select("*", table.part_of_key()).write.parquet(scratch)
    loaded = spark.read.parquet(scratch)
    # a row for each partition at most
    parts = {r[0] for r in loaded.select(PART).distinct().collect()}
    if not parts:
        return table
    rows = change(touched_rows(spark, table, sorted(parts)), loaded.drop(PART))
    others = {p: place for p, place in _places(spark, table.current).items() if p not in parts}
    after = _next_version(spark, table, rows.select(*spark.table(name).columns), others)
    remove_folder(spark, scratch)
    return after


# -- loads ------------------------------------------------------------------


def upsert_keyed(
    spark: SparkSession, name: str, source: DataFrame, order_by: str | None = None
) -> KeyedTable:
    """Rows of the source replace those of their key; rows of other keys are added."""
    keys = keyed_table(spark, name).keys
    return load_keyed(
        spark, name, source, lambda old, new: merge.merge_rows(old, new, keys, order_by=order_by)
    )


def insert_absent_keyed(
    spark: SparkSession, name: str, source: DataFrame, order_by: str | None = None
) -> KeyedTable:
    """Rows of the source whose key the table lacks are added."""
    keys = keyed_table(spark, name).keys
    return load_keyed(
        spark, name, source,
        lambda old, new: merge.merge_rows(old, new, keys, columns=[], order_by=order_by, first=True),
    )


def update_keyed(
    spark: SparkSession, name: str, source: DataFrame, columns: Sequence[str]
) -> KeyedTable:
    """Set ``columns`` of the rows whose key is in the source; other keys are ignored."""
    keys = keyed_table(spark, name).keys
    return load_keyed(
        spark, name, source,
        lambda old, new: merge.merge_rows(old, new, keys, columns=columns, insert=False),
    )


def delete_keyed(spark: SparkSession, name: str, values: DataFrame) -> KeyedTable:
    """Remove the rows whose key is among ``values``, a frame of the key column."""
    (key,) = keyed_table(spark, name).keys
    return load_keyed(spark, name, values, lambda old, new: merge.remove_rows(old, new, key))


def load_history(
    spark: SparkSession, name: str, stage: DataFrame, now, *, compare: Sequence[str] | None = None
) -> KeyedTable:
    """A type 2 load: see ``merge.merge_history``."""
    (key,) = keyed_table(spark, name).keys
    return load_keyed(
        spark, name, stage,
        lambda old, new: merge.merge_history(old, new, now, key=key, compare=compare),
    )


def load_keyed_by_mode(
    spark: SparkSession, mode: str, name: str, source: DataFrame, order_by: str | None = None
) -> KeyedTable:
    loads = {STAGE_MODE: insert_absent_keyed, SCD1_MODE: upsert_keyed}
    if mode not in loads:
        raise KeyError(f"unknown load mode {mode!r}: use {' or '.join(map(repr, loads))}")
    return loads[mode](spark, name, source, order_by)


def append_keyed(spark: SparkSession, name: str, source: DataFrame) -> KeyedTable:
    """Add rows whose keys the table has to lack; one that it has, or that repeats, is an error."""
    keys = keyed_table(spark, name).keys

    def added(old: DataFrame, new: DataFrame) -> DataFrame:
        after = old.unionByName(new)
        require_key(after.select(*keys), keys)
        return after

    return load_keyed(spark, name, source, added)

