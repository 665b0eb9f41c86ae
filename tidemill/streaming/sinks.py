"""Streaming outputs. Every query needs a checkpoint folder of its own.

The table sinks write each micro-batch to a folder named after its number, and then
a commit file. They overwrite the folder when the batch runs again, so a restart
changes nothing, and readers look at committed batches only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tidemill.session import ROCKSDB_STATE
from tidemill.shared import matching_paths, remove_folder, write_text
from tidemill.sources.catalog import add_partitions, balanced_writer, create_table

BATCH = "batch_id"
COMMITS = "_commits"
#: Batches of a keyed table after which earlier ones are compacted.
COMPACT_AFTER = 20
#: The type of a running total.
TOTAL_TYPE = "decimal(38,2)"
HEAP_STATE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"


def file_stream_writer(
    stream: DataFrame,
    checkpoint: str,
    path: str | None = None,
    *,
    trigger: str = "5 seconds",
    mode: str = "append",
    fmt: str = "parquet",
    partitions: Sequence[str] | str | None = None,
) -> DataStreamWriter:
    """A configured writer that the caller starts; unset options are left out."""
    writer = (
        stream.writeStream.format(fmt)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=trigger)
        .outputMode(mode)
    )
    if partitions:
        names = [partitions] if isinstance(partitions, str) else list(partitions)
        writer = writer.partitionBy(*names)
    if path:
        writer = writer.option("path", path)
    return writer


def console_writer(
    stream: DataFrame, checkpoint: str, *, mode: str = "complete", trigger: str = "1 second"
) -> DataStreamWriter:
    return file_stream_writer(stream, checkpoint, trigger=trigger, mode=mode, fmt="console")


def batch_writer(
    stream: DataFrame,
    checkpoint: str,
    each_batch: Callable[[DataFrame, int], None],
    *,
    mode: str = "append",
    trigger: str = "5 seconds",
) -> DataStreamWriter:
    """A writer that hands each micro-batch to ``each_batch``."""
    return (
        stream.writeStream.foreachBatch(each_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=trigger)
        .outputMode(mode)
    )


def batch_folder(base: str, batch_id: int) -> str:
    return f"{base}/{BATCH}={batch_id}"


def write_batch(base: str) -> Callable[[DataFrame, int], None]:
    """Write each micro-batch to its folder, then its commit."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(base, batch_id))
        write_text(batch.sparkSession, f"{base}/{COMMITS}/{batch_id}", "")

    return write


def insert_batch(table: str, base: str) -> Callable[[DataFrame, int], None]:
    """Each micro-batch becomes the partition ``batch_id`` of a catalog table.

    The table lies at ``base`` and has ``batch_id`` as its partition column.
    Overwriting the partition makes a repeated batch harmless.
    """

    def insert(batch: DataFrame, batch_id: int) -> None:
        # gathered into files by size, however many tasks the stream's state has
        batch.hint("rebalance").write.mode("overwrite").parquet(batch_folder(base, batch_id))
        batch.sparkSession.sql(
            f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION ({BATCH} = {batch_id})"
        )

    return insert


def table_batch(table: str, base: str, partition_by: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """Append each micro-batch to a catalog table partitioned by its columns and, last, ``batch_id``.

    A batch that runs again overwrites its own partitions, rows of a partition value
    are gathered in few files, and the catalog learns of the partitions written.
    """
    parts = [*partition_by, BATCH]

    def append(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn(BATCH, F.lit(batch_id).cast("bigint"))
        writer = balanced_writer(rows, parts).mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").parquet(base)
        add_partitions(rows, table, parts)

    return append


def table_writer(
    stream: DataFrame,
    table: str,
    base: str,
    checkpoint: str,
    partition_by: Sequence[str],
    trigger: str = "5 seconds",
) -> DataStreamWriter:
    """Stream rows into the catalog table ``table`` at ``base``, which is made if it isn't there."""
    spark = stream.sparkSession
    columns = dict(stream.dtypes) | {BATCH: "bigint"}
    placed = {c: columns[c] for c in columns if c not in partition_by and c != BATCH}
    placed |= {c: columns[c] for c in (*partition_by, BATCH)}
    create_table(spark, table, placed, partition_by=[*partition_by, BATCH], location=base)
    return batch_writer(stream, checkpoint, table_batch(table, base, partition_by), trigger=trigger)


def appended_table_writer(
    stream: DataFrame, base: str, checkpoint: str, trigger: str = "5 seconds"
) -> DataStreamWriter:
    """Append rows to the table at ``base``; read it with ``read_appended``."""
    return batch_writer(stream, checkpoint, write_batch(base), trigger=trigger)


def keyed_table_writer(
    aggregate: DataFrame,
    table: str,
    base: str,
    checkpoint: str,
    keys: Sequence[str],
    *,
    trigger: str = "1 second",
    compact_after: int = COMPACT_AFTER,
) -> DataStreamWriter:
    """Keep the current row of every key of an aggregate; read it with ``read_latest``.

    The rows that a micro-batch changes are the partition ``batch_id`` of the catalog
    table, which lies at ``base`` and is made if it isn't there. After every
    ``compact_after`` batches the earlier ones are compacted.
    """
    spark = aggregate.sparkSession
    columns = dict(aggregate.dtypes) | {BATCH: "bigint"}
    create_table(spark, table, columns, partition_by=[BATCH], location=base)
    write = change_batch(table, base, keys, compact_after)
    return batch_writer(aggregate, checkpoint, write, mode="update", trigger=trigger)


def change_batch(
    table: str, base: str, keys: Sequence[str], compact_after: int = COMPACT_AFTER
) -> Callable[[DataFrame, int], None]:
    insert = insert_batch(table, base)

    def write(batch: DataFrame, batch_id: int) -> None:
        insert(batch, batch_id)
        if batch_id % compact_after == compact_after - 1:
            # a batch that has a successor is not written again
            compact(batch.sparkSession, table, base, keys, batch_id - 1)

    return write


def latest_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of every key the row of its last batch, with its number; a partial + final aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), BATCH).alias("_row"))
    return last.select(*keys, "_row.*").select(*rows.columns)


def compact(spark: SparkSession, table: str, base: str, keys: Sequence[str], up_to: int) -> None:
    """Gather the last rows of all batches up to one in the partition of that batch.

    The partition is pointed at the gathered rows before older ones are dropped. In
    between older rows are there twice, which changes no key's last row; so the job may
    be cut short and run again at any point. The number of files follows the size.
    """
    earlier = spark.table(table).where(F.col(BATCH) <= up_to)
    parts = [
        number for number in batch_partitions(spark, table) if number <= up_to
    ]
    if len(parts) < 2:
        return
    places = {file.rsplit("/", 1)[0] for file in earlier.inputFiles()}
    last = parts[-1]
    target = f"{base}/compacted-{last}-{uuid.uuid4().hex}"
    latest_rows(earlier, keys).drop(BATCH).hint("rebalance").write.parquet(target)
    spark.sql(f"ALTER TABLE {table} PARTITION ({BATCH} = {last}) SET LOCATION '{target}'")
    older = ", ".join(f"PARTITION ({BATCH} = {n})" for n in parts[:-1])
    spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {older}")
    for place in places:
        remove_folder(spark, unquote(place))


def batch_partitions(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the batches that the catalog knows of, ascending."""
    rows = spark.sql(f"SHOW PARTITIONS {table}").collect()
    return sorted(int(row[0].rsplit("=", 1)[1]) for row in rows)


def total_writer(
    changes: DataFrame, base: str, checkpoint: str, amount: str, *, trigger: str = "1 second"
) -> DataStreamWriter:
    """The sum of ``amount`` over all batches so far, one row (batch_id, change, total) per batch.

    A batch adds its own sum to the total of the batch before, so its work is that
    of its rows; a batch that runs again gives the same row. Read with ``read_totals``.
    """

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [n for n in committed(spark, base) if n < batch_id]
        carried = F.lit(0)
        if before:
            carried = F.lit(spark.read.parquet(batch_folder(base, before[-1])).first()["total"])
        change = F.coalesce(F.sum(amount), F.lit(0)).cast(TOTAL_TYPE)
        row = batch.agg(change.alias("change")).select(
            "change", (F.col("change") + carried.cast(TOTAL_TYPE)).cast(TOTAL_TYPE).alias("total")
        )
        write_batch(base)(row, batch_id)

    return batch_writer(changes, checkpoint, each_batch, mode="update", trigger=trigger)


def snapshot_writer(
    aggregate: DataFrame,
    base: str,
    checkpoint: str,
    *,
    trigger: str = "1 second",
    keep_last: int = 2,
) -> DataStreamWriter:
    """Write the whole result after each batch; read with ``read_snapshot``.

    Older snapshots are removed, but for the last ``keep_last``.
    """
    write = write_batch(base)

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        write(batch, batch_id)
        spark = batch.sparkSession
        for old in finished_batches(spark, base)[:-keep_last]:
            remove_folder(spark, batch_folder(base, old))
            remove_folder(spark, f"{base}/{COMMITS}/{old}")

    return batch_writer(aggregate, checkpoint, each_batch, mode="complete", trigger=trigger)


def committed(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the batches whose commit is written, ascending."""
    return sorted(int(p.rsplit("/", 1)[1]) for p in matching_paths(spark, f"{base}/{COMMITS}/[0-9]*"))


def finished_batches(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the batch folders written completely, ascending.

    Commits are files of their own, so they don't depend on markers that a file system
    or a setting may leave out. A folder without a commit is an error unless it is the
    last one, which may be being written.
    """
    done = committed(spark, base)
    there = {
        int(path.rsplit("=", 1)[1]) for path in matching_paths(spark, f"{base}/{BATCH}=*")
    }
    lost = [n for n in there - set(done) if done and n < done[-1]]
    if lost:
        raise RuntimeError(f"batches {sorted(lost)} in {base} were not committed")
    return done


def read_appended(spark: SparkSession, base: str) -> DataFrame:
    return _read_batches(spark, base).drop(BATCH)


def read_snapshot(spark: SparkSession, base: str) -> DataFrame:
    batches = finished_batches(spark, base)
    if not batches:
        raise FileNotFoundError(f"no finished snapshot in {base}")
    return spark.read.parquet(batch_folder(base, batches[-1]))


def read_latest(spark: SparkSession, table: str, keys: Sequence[str]) -> DataFrame:
    """The current row of every key of a keyed table."""
    if not spark.catalog.tableExists(table) or not batch_partitions(spark, table):
        raise FileNotFoundError(f"no finished batch in {table}")
    spark.catalog.refreshTable(table)
    return latest_rows(spark.table(table), keys).drop(BATCH)


def read_totals(spark: SparkSession, base: str) -> DataFrame:
    """Rows of ``total_writer``: batch_id, change and total."""
    return _read_batches(spark, base).select(F.col(BATCH).cast("bigint").alias(BATCH), "change", "total")


def _read_batches(spark: SparkSession, base: str) -> DataFrame:
    batches = finished_batches(spark, base)
    if not batches:
        raise FileNotFoundError(f"no finished batch in {base}")
    rows = spark.read.option("basePath", base)
    return rows.parquet(*[batch_folder(base, n) for n in batches])


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Start queries with their state on RocksDB instead of the executor heap.

    A session that already names a state store of its own is left alone.
    """
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    if before == HEAP_STATE:
        spark.conf.set(setting, ROCKSDB_STATE)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def drain(
    spark: SparkSession, writer: DataStreamWriter, timeout: float | None = None
) -> StreamingQuery:
    """Process everything that is there, then stop; by default without a time limit."""
    with rocksdb_state(spark):
        query = writer.trigger(availableNow=True).start()
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"stream did not finish within {timeout} seconds")
    return query
