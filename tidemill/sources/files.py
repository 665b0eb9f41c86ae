"""Text, CSV, JSON, Parquet and raw file sources and sinks."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.schema import DeclaredTable
from tidemill.shared import is_folder, new_folder


def read_lines(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    return spark.read.text(path).toDF(column)


# Quotes inside a field are doubled, and spaces around a field belong to it.
CSV_RULES = {
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
# A row that can't be read, or doesn't fit its schema, raises.
STRICT = {"mode": "FAILFAST"}


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    *,
    sampling: float = 1.0,
    separator: str = ",",
    header: bool = True,
    multi_line: bool = False,
) -> DataFrame:
    """CSV with a header. Without a schema, types come from a ``sampling`` share
    of the rows, which costs an extra pass; a row that doesn't fit them raises.
    Fields with line breaks need ``multi_line``, which gives every file to one task."""
    reader = spark.read.options(**CSV_RULES, **STRICT).option("header", header).option("sep", separator)
    reader = reader.option("multiLine", multi_line)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).option("samplingRatio", sampling).csv(path)


def write_csv(
    df: DataFrame, path: str, *, separator: str = ",", header: bool = True, mode: str = "errorifexists"
) -> None:
    writer = df.write.mode(mode).options(**CSV_RULES)
    writer.option("header", header).option("sep", separator).csv(path)


#: What a dump writes for characters that would end a field or a line, backslashes first.
ESCAPES = (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"))


def _replaced(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def dump_text(df: DataFrame, path: str) -> None:
    """Dump a table as tab-separated text, one line for each row, null as ``\\N``.

    Backslashes, tabs and line breaks in fields are escaped, so that files can be split
    between tasks at any line.
    """

    def field(name: str) -> Column:
        text = F.col(f"`{name}`").cast("string")
        for meant, written in ESCAPES:
            text = _replaced(text, meant, written)
        return F.coalesce(text, F.lit("\\N"))

    df.select(F.concat_ws("\t", *map(field, df.columns)).alias("value")).write.text(path)


def _undumped(text: Column) -> Column:
    """The field that ``dump_text`` wrote as ``text``."""
    # a written backslash becomes \p first, which is not written otherwise
    text = _replaced(text, "\\\\", "\\p")
    for meant, written in ESCAPES[1:]:
        text = _replaced(text, written, meant)
    return _replaced(text, "\\p", "\\")


def load_text(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Read what ``dump_text`` wrote; a row of another width, or a bad value, raises."""
    if isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    fields = F.split("value", "\t", -1)
    width = len(schema.fields)
    wrong = F.raise_error(F.concat(F.lit("row of another width: "), F.col("value")))
    rows = spark.read.text(path, lineSep="\n").select(
        F.when(F.size(fields) == width, fields).otherwise(wrong.cast("array<string>")).alias("f")
    )
    return rows.select(
        *[
            F.when(F.col("f")[i] != "\\N", _undumped(F.col("f")[i])).cast(f.dataType).alias(f.name)
            for i, f in enumerate(schema.fields)
        ]
    )


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.options(**STRICT).schema(schema).json(path)


def read_table_path(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def save_table_path(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Save to a path; by default an existing path is an error."""
    df.write.format(fmt).mode(mode).save(path)


def list_objects(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """Path, size and time of the files of a folder; contents are not read."""
    return _objects(spark, folder, pattern, recursive).select("path", "length", "modificationTime")


def load_objects(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """Path and bytes of the files of a folder, one row per file."""
    return _objects(spark, folder, pattern, recursive).select("path", "content")


def _objects(spark: SparkSession, folder: str, pattern: str, recursive: bool) -> DataFrame:
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    return reader.option("recursiveFileLookup", recursive).load(folder)


#: What no line of a CSV file holds: lines are read as one column parted by it.
NO_SEPARATOR = "\x00"
MALFORMED = "MALFORMED row"


def _headers(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """file and header of every matching file: the first line of its first block."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    first = reader.text(folder).where("_metadata.file_block_start = 0")
    placed = first.select(
        "value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("nth")
    )
    return placed.groupBy("file").agg(F.min_by("value", "nth").alias("header"))


def _lines_below_headers(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """file and value of every line but each file's first one, which the reader passes over."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    options = {"header": "true", "sep": NO_SEPARATOR, "quote": "", "escape": "", **STRICT}
    lines = reader.options(**options, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return lines.schema("value string").csv(folder).select(
        "value", F.col("_metadata.file_path").alias("file")
    )


def _cells(widths: list[int]) -> Column:
    """The fields of a line, as many as its file's header has; another number raises."""
    cells = F.lit(None).cast("array<string>")
    for width in widths:
        schema = ", ".join(f"_{i} string" for i in range(width))
        options = {k: str(v) for k, v in CSV_RULES.items()} | STRICT
        row = F.from_csv("value", schema, options)
        cells = F.when(F.col("width") == width, F.array(*[row[f"_{i}"] for i in range(width)])).otherwise(cells)
    return cells


def _checked(value: Column, bad: Column, message: str) -> Column:
    raised = F.raise_error(F.concat(F.lit(f"{MALFORMED}, {message}: "), F.col("value")))
    return F.when(bad, raised.cast("string")).otherwise(value)


def ingest_declared(
    spark: SparkSession, folder: str, table: DeclaredTable, pattern: str = "*.csv"
) -> DataFrame:
    """All matching CSV files under a folder, as the declared columns.

    Each file's columns are bound by its own header, its first line: a small table
    says in which place a file has each column, and a line's cells are taken from
    there, so lines are read once, however many headers there are. Declared columns
    that a file lacks are null, others are left out. A row of another width or with a
    cell that doesn't fit its type raises, and so does a field with a line break, as
    files are split at lines. Only the different headers come to the driver.
    """
    declared = table.to_struct().fields
    headed = _headers(spark, folder, pattern)
    path = new_folder(spark, "headers")
    headed.write.parquet(path)
    headed = spark.read.parquet(path)
    found = sorted(row[0] for row in headed.select("header").distinct().collect())
    if not found:
        return spark.createDataFrame([], table.to_struct())
    names = {header: next(csv.reader([header])) for header in found}
    places = [
        (header, len(own), [own.index(f.name) if f.name in own else None for f in declared])
        for header, own in names.items()
    ]
    bound = headed.join(
        spark.createDataFrame(places, "header string, width int, places array<int>"), "header"
    ).select("file", "width", "places")
    lines = _lines_below_headers(spark, folder, pattern).join(bound, "file")
    quotes = F.length(F.regexp_replace("value", '[^"]+', ""))
    whole = lines.withColumn(
        "value", _checked(F.col("value"), quotes % 2 == 1, "a field with a line break or an open quote")
    )
    rows = whole.select("value", "places", _cells(sorted({len(own) for own in names.values()})).alias("cells"))

    def column(i: int, f: T.StructField) -> Column:
        cell = F.when(F.col("places")[i].isNotNull(), F.get("cells", F.col("places")[i]))
        typed = cell.try_cast(f.dataType)
        checked = _checked(F.lit(None), cell.isNotNull() & typed.isNull(), f"no {f.dataType.simpleString()}")
        return F.coalesce(typed, checked.cast(f.dataType)).alias(f.name, metadata=f.metadata)

    return rows.select(*[column(i, f) for i, f in enumerate(declared)])


def stream_folder_options(spark: SparkSession, path: str) -> tuple[str, dict[str, str]]:
    """Folder and options that stream ``path``, be it a folder or a single file."""
    if is_folder(spark, path):
        return path, {}
    folder, _, name = path.rpartition("/")
    return folder, {"pathGlobFilter": name}
