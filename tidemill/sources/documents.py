"""Documents without a schema: collections of JSON objects that differ in their fields.

A document is a VARIANT: fields are looked up by path when they are needed, and the
types found in a collection can be asked for. The same frames go to and come from a
document database by the options in ``connectors``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "document"


def read_documents(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """JSON documents, one per line, as the column ``document``; one that can't be read raises.

    ``multi_line`` reads documents over several lines, each file in one task.
    """
    reader = spark.read.option("singleVariantColumn", DOCUMENT).option("mode", "FAILFAST")
    return reader.option("multiLine", multi_line).json(path)


def parse_documents(df: DataFrame, text: str, *, strict: bool = True) -> DataFrame:
    """``df`` with the JSON of a text column as ``document``; without ``strict`` bad texts are null."""
    parse = F.parse_json if strict else F.try_parse_json
    return df.withColumn(DOCUMENT, parse(F.col(text)))


def field(path: str, kind: str, *, strict: bool = False) -> Column:
    """The value at a path like ``$.a.b[0]``: null if it lacks, or can't be read as ``kind``.

    With ``strict`` a value of another kind raises; one that lacks is null all the same.
    """
    get = F.variant_get if strict else F.try_variant_get
    return get(F.col(DOCUMENT), path, kind)


def with_fields(docs: DataFrame, fields: Mapping[str, tuple[str, str]], *, strict: bool = False) -> DataFrame:
    """``docs`` with a column for each of ``fields``: its path and type."""
    return docs.withColumns({name: field(*told, strict=strict) for name, told in fields.items()})


def without_fields(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` whose documents lack some top-level fields; other fields may be any."""
    kept = F.map_filter(
        F.variant_get(F.col(DOCUMENT), "$", "map<string, variant>"), lambda name, _: ~name.isin(*names)
    )
    return docs.withColumn(DOCUMENT, F.parse_json(F.to_json(kept)))


def collection_schema(docs: DataFrame) -> str:
    """The type that all documents fit in, as DDL; fields of several types are variants."""
    found = docs.agg(F.schema_of_variant_agg(F.col(DOCUMENT)).alias("schema")).first()["schema"]
    return found.replace("OBJECT<", "STRUCT<")


def as_documents(df: DataFrame, *columns: str) -> DataFrame:
    """Rows as documents of their columns, by default all; a null column is a field that lacks."""
    row = F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "true"})
    return df.select(F.parse_json(row).alias(DOCUMENT))


def write_documents(docs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON document per line."""
    docs.select(F.to_json(DOCUMENT).alias("value")).write.mode(mode).text(path)


def typed_rows(docs: DataFrame) -> DataFrame:
    """Documents as rows of the fields found in any of them; one pass finds the types."""
    schema = collection_schema(docs)
    if not schema.startswith("STRUCT<"):
        raise ValueError(f"documents are no objects: {schema}")
    return docs.select(field("$", schema, strict=True).alias(DOCUMENT)).select(f"{DOCUMENT}.*")
