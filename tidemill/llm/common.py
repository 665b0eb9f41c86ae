"""Helpers that several operators of this package use."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.shared import new_folder

#: White space between words: space and the ASCII controls 9 to 13.
SPACE = "[\\x20\\x09-\\x0D]+"

#: Rows of two or three numbers that may be sent to every executor, and bytes of any table.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 24 << 20


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives executors."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row of ``df`` takes: its texts' and lists' own sizes, and eight for a number."""

    def size(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return 16 + F.coalesce(F.octet_length(column), F.lit(0))
        if isinstance(field.dataType, T.ArrayType):
            return 24 + 8 * F.greatest(F.size(column), F.lit(0))
        return F.lit(8)

    return functools.reduce(Column.__add__, map(size, df.schema.fields), F.lit(8)).cast("long")


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, a stored table, to be broadcast if the bytes of its rows allow it; else left to a shuffle."""
    total = df.agg(F.sum(row_bytes(df))).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


def row_key(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> list[Column]:
    """Id and text hash: what tells rows apart whose ids repeat or are null."""
    return [docs[id_column], F.xxhash64(docs[text])]


def rows_with(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose ``row_key`` is (``left_semi``) or isn't (``left_anti``) in ``keys``.

    ``keys`` is a stored table of the columns ``row_id`` and ``row_hash``. Nulls
    are equal here. Only the columns of ``docs`` come out, so none can clash.
    """
    doc_id, text_hash = row_key(docs)
    keys = keys.select(F.col("row_id").alias("__row_id"), F.col("row_hash").alias("__row_hash"))
    found = doc_id.eqNullSafe(F.col("__row_id")) & (text_hash == F.col("__row_hash"))
    return docs.join(small_side(keys), found, how)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row for each ``row_key``; of several the least by their JSON form.

    Equal rows meet in a partial aggregate before the shuffle.
    """
    doc_id, text_hash = row_key(docs)
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    picked = docs.groupBy(doc_id.alias("__row_id"), text_hash.alias("__row_hash")).agg(
        F.min_by(whole, F.to_json(whole)).alias("__row")
    )
    return picked.select("__row.*")
