"""Options for sources and sinks whose jars come with the cluster.

Each function returns the options of one Spark format; ``read`` and ``write``
apply them. Addresses and credentials are always passed in.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, DataFrameReader, DataFrameWriter, SparkSession

WRITE_BATCH = 10_000


def document_read_options(uri: str, database: str, collection: str) -> dict[str, str]:
    """Options of ``format("mongodb")`` for reading one collection."""
    return {
        "spark.mongodb.read.connection.uri": uri,
        "spark.mongodb.read.database": database,
        "spark.mongodb.read.collection": collection,
    }


def document_write_options(
    uri: str, database: str, collection: str, batch_size: int = WRITE_BATCH
) -> dict[str, str]:
    return {
        "spark.mongodb.write.connection.uri": uri,
        "spark.mongodb.write.database": database,
        "spark.mongodb.write.collection": collection,
        "spark.mongodb.write.batch.size": str(batch_size),
    }


def topic_read_options(
    address: str, port: int | str, topic: str, starting: str = "earliest"
) -> dict[str, str]:
    """Options of ``format("kafka")`` for one topic; lost offsets do not fail the query."""
    return {
        "kafka.bootstrap.servers": f"{address}:{port}",
        "subscribe": topic,
        "startingOffsets": starting,
        "failOnDataLoss": "false",
    }


def topic_write_options(address: str, port: int | str, topic: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": f"{address}:{port}", "topic": topic}


def socket_options(host: str, port: int | str) -> dict[str, str]:
    return {"host": host, "port": str(port)}


def query_options(
    url: str,
    query: str,
    *,
    partition_column: str | None = None,
    lower: object = None,
    upper: object = None,
    partitions: int | None = None,
    fetch_size: int = WRITE_BATCH,
    **properties: str,
) -> dict[str, str]:
    """Options of ``format("jdbc")`` that read the result of a query.

    With a partition column the query is read in slices by several tasks; Spark
    takes that only with ``dbtable``, so the query becomes a derived table.
    """
    options = {"url": url, "fetchsize": str(fetch_size), **properties}
    if partition_column is None:
        return {**options, "query": query}
    if lower is None or upper is None or partitions is None:
        raise ValueError("a partition column needs lower, upper and partitions")
    return {
        **options,
        "dbtable": f"({query}) AS source_query",
        "partitionColumn": partition_column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
    }


def table_write_options(
    url: str, table: str, batch_size: int = WRITE_BATCH, **properties: str
) -> dict[str, str]:
    """Options of ``format("jdbc")`` that insert in batches."""
    return {"url": url, "dbtable": table, "batchsize": str(batch_size), **properties}


def read(spark: SparkSession, fmt: str, options: Mapping[str, str]) -> DataFrameReader:
    return spark.read.format(fmt).options(**options)


def write(
    df: DataFrame, fmt: str, options: Mapping[str, str], mode: str = "append"
) -> DataFrameWriter:
    return df.write.format(fmt).mode(mode).options(**options)
