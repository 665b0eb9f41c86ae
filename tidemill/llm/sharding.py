"""Shards by fixed virtual slots: rows to slots by a hash, slots to shards by a stored map.

The number of slots never changes, so the hash of a row doesn't either. Bytes are
summed up per slot; only the map from slots to shards is edited when sizes or the
number of shards change, and each edit is stored as a new version in the map's folder,
where the next run finds it. The map has one row per slot, whatever the number of rows.
Rows that nothing tells apart are counted and numbered, and their numbers are hashed
too, so that they are spread like any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import store
from tidemill.shared import matching_paths, write_text

#: Virtual slots.
SLOTS = 4096
SHARDS = 16
#: Rows alike that one task numbers at a time.
PIECE = 10_000


def slot_of(slots: int) -> Column:
    """Slot of a row: 32 bits of the MD5 of its id, or of its text's checksum if it has none.

    Of rows alike the first one has that slot; the others hash their number as well.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), F.col("text_crc32")))
    name = F.when(F.col("copy") == 0, name).otherwise(F.concat(name, F.lit("#"), F.col("copy")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") % slots


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, copy and virtual slot of every row.

    Rows of one id, size and checksum are counted, and dealt out again in pieces of
    ``PIECE`` rows, numbered by ``copy``; they differ in nothing else.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    alike = ["doc_id", "size", "text_crc32"]
    counted = (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        )
        .groupBy(*alike)
        .agg(F.count("*").alias("n"))
    )
    first = counted.select(*alike, F.lit(0).cast("long").alias("copy"))
    pieces = counted.where("n > 1").select(
        *alike, "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {PIECE})")).alias("piece")
    )
    others = pieces.repartition("doc_id", "text_crc32", "piece").select(
        *alike,
        F.explode(
            F.expr(f"sequence(greatest(piece * {PIECE}, 1L), least((piece + 1) * {PIECE}, n) - 1)")
        ).alias("copy"),
    )
    # a last piece of the first row alone would count down
    others = others.where("copy > 0")
    return first.unionByName(others).withColumn("vslot", slot_of(slots))


def slot_sizes(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each slot that has any."""
    return rows.groupBy("vslot").agg(
        F.sum("size").alias("slot_bytes"), F.count("*").alias("slot_rows")
    )


def empty_map(rows: DataFrame) -> DataFrame:
    """A map, version 0, of no slots."""
    return rows.sparkSession.createDataFrame([], "vslot long, shard int, version int")


def edit_map(old: DataFrame, sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of the map ``old`` for slots of these sizes.

    Slots stay where they are as long as their shard keeps within the mean size,
    largest slots first; the others, and new slots, go one by one, largest first, to
    the shard that is smallest at that time. Ties go to the smaller slot and shard.
    The result has one row for each slot in ``sizes``, its bytes and rows.
    """
    mean = F.sum("slot_bytes").over(Window.partitionBy()) / F.lit(shards)
    # windows over one row per slot: at most the fixed number of slots
    filled = F.sum("slot_bytes").over(
        Window.partitionBy("old_shard").orderBy(F.desc("slot_bytes"), "vslot")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = (
        sizes.join(old.select("vslot", F.col("shard").alias("old_shard")), "vslot", "left")
        .withColumn("mean", mean)
        .withColumn("filled", filled)
        .withColumn(
            "stays", F.expr(f"coalesce(old_shard < {shards} and filled <= mean, false)")
        )
    )
    listed = placed.agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    (~F.col("stays")).alias("moves"),
                    (-F.col("slot_bytes")).alias("less"),
                    "vslot",
                    "slot_rows",
                    F.when(F.col("stays"), F.col("old_shard")).alias("shard"),
                )
            )
        ).alias("slots")
    )
    # kept slots come first in the fold and fill their shards, then the others are placed
    place = f"""
      aggregate(slots,
        struct(array_repeat(0L, {shards}) as loads, cast(array() as array<int>) as shards),
        (acc, s) -> transform(array(
            coalesce(s.shard, cast(array_position(acc.loads, array_min(acc.loads)) - 1 as int))),
          at -> struct(
            transform(acc.loads, (l, i) -> if(i = at, l - s.less, l)) as loads,
            concat(acc.shards, array(at)) as shards))[0],
        acc -> acc.shards)
    """
    version = old.agg(F.coalesce(F.max("version"), F.lit(0)) + 1).first()[0]
    return (
        listed.select("slots", F.expr(place).alias("shards"))
        .select(F.explode(F.arrays_zip("slots", "shards")).alias("z"))
        .select(
            F.col("z.slots.vslot").alias("vslot"),
            F.col("z.shards").alias("shard"),
            F.lit(version).alias("version"),
            (-F.col("z.slots.less")).alias("slot_bytes"),
            F.col("z.slots.slot_rows").alias("slot_rows"),
        )
    )


def map_versions(spark: SparkSession, folder: str) -> list[int]:
    """Versions of the map in ``folder`` that were written whole, ascending."""
    return sorted(int(path.rsplit("/", 1)[1]) for path in matching_paths(spark, f"{folder}/_done/[0-9]*"))


def last_map(rows: DataFrame, folder: str) -> DataFrame:
    """The last version of the map in ``folder``, or one of no slots."""
    spark = rows.sparkSession
    versions = map_versions(spark, folder)
    if not versions:
        return empty_map(rows)
    return spark.read.parquet(f"{folder}/version={versions[-1]}")


def store_map(edited: DataFrame, folder: str) -> DataFrame:
    """The map, written as the next version in ``folder``; earlier ones stay."""
    spark = edited.sparkSession
    version = max([0, *map_versions(spark, folder)]) + 1
    path = f"{folder}/version={version}"
    edited.coalesce(1).write.mode("overwrite").parquet(path)
    write_text(spark, f"{folder}/_done/{version}", "")
    return spark.read.parquet(path)


def positions(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows`` with their shard and their place in it, gapless from 0.

    Rows are numbered within their virtual slot, by id, checksum and size; a slot
    begins where the slots before it in its shard end. The broadcast map has one row
    per slot.
    """
    before = F.sum("slot_rows").over(
        Window.partitionBy("shard").orderBy("vslot")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = slot_map.select(
        "vslot", "shard", F.coalesce(before, F.lit(0)).alias("slot_start")
    )
    within = F.row_number().over(
        Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    )
    return (
        rows.withColumn("nth", within)
        .join(F.broadcast(starts), "vslot")
        .withColumn("slot", (F.col("slot_start") + F.col("nth") - 1).cast("long"))
        .drop("slot_start", "nth")
    )


def shard_by_bytes(
    docs: DataFrame, folder: str, shards: int = SHARDS, slots: int = SLOTS
) -> DataFrame:
    """Every row of ``docs``, as doc_id, size and checksum, with shard, place and virtual slot.

    Shards are nearly equal in bytes. The last map in ``folder`` is edited for the rows
    and the number of shards, and stored there as its next version: what a shard holds
    beyond the mean moves, everything else stays. Size is the text's UTF-8 bytes and 1; a
    null text has no bytes and the checksum of nothing. A row without an id goes by
    its checksum, and rows alike, repeated ones or copies without an id, are spread over
    slots. An empty table gives no rows; other columns are not read.
    """
    rows = store(records(docs, slots), "shard-rows")
    slot_map = store_map(edit_map(last_map(rows, folder), slot_sizes(rows), shards), folder)
    return positions(rows, slot_map)
