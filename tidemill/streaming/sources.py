"""Unbounded inputs."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.sources.connectors import socket_options, topic_read_options
from tidemill.sources.files import stream_folder_options

# The columns of a topic record.
TOPIC_SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)


def socket_lines(spark: SparkSession, host: str, port: int | str) -> DataFrame:
    """Text lines of a socket, column ``value``."""
    return spark.readStream.format("socket").options(**socket_options(host, port)).load()


def text_lines(
    spark: SparkSession,
    folder: str,
    files_per_batch: int | None = None,
    *,
    archive: str | None = None,
) -> DataFrame:
    """Lines of the text files that appear in a folder, column ``value``.

    With ``archive`` the files of a batch are moved there once the next one is planned,
    so that the folder is listed quickly; a file that is still there is never read twice.
    """
    reader = _reader(spark, files_per_batch).option("lineSep", "\n")
    if archive is not None:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.text(folder)


def counted_rows(spark: SparkSession, rows_per_batch: int, start: str = "2024-01-01") -> DataFrame:
    """A clock of rows: column ``id`` counts from 0, ``rows_per_batch`` more in every batch.

    Numbers come from the batch's offset in the checkpoint, so a batch that runs again has
    the same ones. ``timestamp`` moves on by a second per batch.
    """
    millis = int(datetime.fromisoformat(start).replace(tzinfo=timezone.utc).timestamp() * 1000)
    clock = (
        spark.readStream.format("rate-micro-batch")
        .option("rowsPerBatch", rows_per_batch)
        .option("startTimestamp", millis)
        .option("advanceMillisPerBatch", 1000)
        .load()
    )
    return clock.select(F.col("value").alias("id"), "timestamp")


def topic_stream(
    spark: SparkSession, address: str, port: int | str, topic: str, starting: str = "earliest"
) -> DataFrame:
    options = topic_read_options(address, port, topic, starting)
    return spark.readStream.format("kafka").options(**options).load()


def table_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """The Parquet files of a table as a stream; ``path`` may be a single file."""
    schema = schema or spark.read.parquet(path).schema
    folder, options = stream_folder_options(spark, path)
    return _reader(spark, files_per_batch).schema(schema).options(**options).parquet(folder)


def _reader(spark: SparkSession, files_per_batch: int | None):
    reader = spark.readStream
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader
