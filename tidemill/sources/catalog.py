"""Databases and tables of the session catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.files import load_text


class DuplicateKey(ValueError):
    """A primary key that is null or not unique."""


def run_statement(spark: SparkSession, statement: str) -> DataFrame:
    return spark.sql(statement)


def create_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    at = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}{at}")


def use_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"USE {name}")


def show_databases(spark: SparkSession, catalog: str | None = None) -> DataFrame:
    return spark.sql(f"SHOW SCHEMAS FROM {catalog}" if catalog else "SHOW DATABASES")


def show_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    return spark.sql(f"SHOW TABLES IN {database}" if database else "SHOW TABLES")


def current_database(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT current_database() AS current_database")


def describe_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.sql(f"DESCRIBE EXTENDED {table}")


def register_views(frames: dict[str, DataFrame]) -> None:
    """Create the named temp views, or replace them."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def drop_table(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def truncate_table(spark: SparkSession, table: str) -> None:
    spark.sql(f"TRUNCATE TABLE {table}")


def save_table(
    df: DataFrame,
    table: str,
    *,
    mode: str = "overwrite",
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
) -> None:
    balanced_writer(df, partition_by).format(fmt).mode(mode).saveAsTable(table)


PROFILE = "position int, column string, type string, n_rows long, n_nulls long"


def save_profiled(df: DataFrame, table: str, **options) -> DataFrame:
    """``save_table``, and of each column its name, type, rows and nulls.

    They are counted while the rows go by on their way to the table, so nothing is read
    a second time. Columns of the result are those of ``PROFILE``.
    """
    seen = Observation()
    nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]
    save_table(df.observe(seen, F.count(F.lit(1)).alias("rows"), *nulls), table, **options)
    counted = seen.get
    rows = [
        (i, f.name, f.dataType.simpleString(), counted["rows"], counted[f"n{i}"])
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(rows, PROFILE)


def create_table(
    spark: SparkSession,
    table: str,
    columns: dict[str, str],
    *,
    partition_by: Sequence[str] = (),
    location: str | None = None,
    fmt: str = "parquet",
) -> None:
    """``CREATE TABLE IF NOT EXISTS``; partition columns are named in ``columns``."""
    body = ", ".join(f"`{name}` {kind}" for name, kind in columns.items())
    parts = f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    at = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({body}) USING {fmt}{parts}{at}")


def balanced_writer(df: DataFrame, partition_by: Sequence[str] = ()):
    """A writer whose tasks get even shares of each table partition.

    The rebalance hint gathers the rows of a partition value so that it gets few
    files, and lets AQE split a value that is too large for one task.
    """
    if not partition_by:
        return df.write
    return df.hint("rebalance", *partition_by).write.partitionBy(*partition_by)


def append_partitioned(
    df: DataFrame, path: str, partition_by: Sequence[str], fmt: str = "parquet"
) -> None:
    balanced_writer(df, partition_by).format(fmt).mode("append").save(path)


def add_partitions(df: DataFrame, table: str, partition_by: Sequence[str]) -> None:
    """Make the partitions that ``df`` was written to known to the catalog.

    Costs the partitions of ``df``, however many the table has.
    """

    def spec(row) -> str:
        values = ("NULL" if v is None else "'" + str(v).replace("'", "\\'") + "'" for v in row)
        pairs = ", ".join(f"`{c}` = {v}" for c, v in zip(partition_by, values, strict=True))
        return f"PARTITION ({pairs})"

    written = df.select(*partition_by).distinct().collect()
    if written:
        specs = " ".join(map(spec, written))
        df.sparkSession.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {specs}")


def insert_by_name(df: DataFrame, table: str) -> None:
    """Append to a table, matching columns by name.

    ``insertInto`` alone matches by position and writes swapped columns without
    complaint.
    """
    spark = df.sparkSession
    wanted = spark.table(table).columns
    missing = [c for c in wanted if c not in df.columns]
    extra = [c for c in df.columns if c not in wanted]
    if missing or extra:
        raise ValueError(f"{table}: missing columns {missing}, unknown columns {extra}")
    df.select(*wanted).write.mode("append").insertInto(table)


def load_text_into(spark: SparkSession, path: str, table: str) -> None:
    """Bulk-load a text dump (``files.dump_text``) into an existing table."""
    insert_by_name(load_text(spark, path, spark.table(table).schema), table)


def require_key(df: DataFrame, key: Sequence[str]) -> None:
    """Raise unless ``key`` is set and unique; one partial + final count."""
    null_key = F.lit(False)
    for column in key:
        null_key = null_key | F.col(column).isNull()
    repeated = df.groupBy(*key).count().filter((F.col("count") > 1) | null_key).limit(1)
    rows = repeated.collect()
    if rows:
        raise DuplicateKey(f"primary key {list(key)} is null or repeated: {rows[0]}")


def append_or_create(df: DataFrame, table: str, primary_key: Sequence[str]) -> DataFrame:
    """Create the table from ``df`` if it is missing, else append by name.

    The key has to be unique within the new rows, and absent from the table.
    """
    spark = df.sparkSession
    require_key(df, primary_key)
    if not spark.catalog.tableExists(table):
        save_table(df, table, mode="errorifexists")
        return df
    stored = spark.table(table).select(*primary_key)
    clash = stored.join(df.select(*primary_key), on=list(primary_key), how="left_semi")
    rows = clash.limit(1).collect()
    if rows:
        raise DuplicateKey(f"{table} already has the key {rows[0]}")
    insert_by_name(df, table)
    return df
