"""Synthetic rows for a declared schema.

Every value is a hash of (row id, column, seed), so the same row comes out under
any partitioning, and a lost task makes the same rows again.
"""

from __future__ import annotations

from collections.abc import Mapping
from difflib import SequenceMatcher
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.columns import epoch_millis, json_record, record_key
from tidemill.schema import DeclaredColumn, DeclaredTable
from tidemill.sources.files import write_csv

DEFAULT_ROWS = 1000
SIMILAR = 0.85

# Words for columns whose name is close to the key.
VOCABULARIES: dict[str, tuple[str, ...]] = {
    "device_types": ("Desktop", "Laptop", "Mobile", "Tablet"),
    "device_brands": ("Apple", "Dell", "Samsung", "Lenovo", "Huawei"),
    "device_models": (
        "iMac 2022", "Dell XPS Desktop", "HP Pavilion",
        "MacBook Pro", "Dell XPS 15", "Lenovo ThinkPad X1",
        "iPhone 13", "Samsung Galaxy S21", "Google Pixel 6",
        "iPad Pro", "Samsung Galaxy Tab S7", "Surface Pro X",
    ),
    "browser_types": ("Chrome", "Firefox", "Safari", "Edge", "Opera"),
    "browser_versions": (
        "90.0.4430.93", "91.0.4472.124", "92.0.4515.159",
        "89.0.1", "90.0.2", "91.0.2", "13.1.2", "14.0.3", "15.0",
        "91.0.864.59", "92.0.902.78", "93.0.961.52",
        "76.0.4017.177", "77.0.4054.277", "78.0.4093.147",
    ),
    "locales": ("en_US", "fr_FR", "de_DE", "es_ES", "zh_CN"),
}

# Bounds of generated numbers and the length of codes.
DOUBLE_LOW, DOUBLE_HIGH = 0.01, 99.99
CODE_LENGTH = 10

CODES = 36**CODE_LENGTH
FRACTIONS = 2**53
VERBS = ("build", "chart", "deliver", "extend", "gather", "improve", "plan", "review")
QUALITIES = ("daily", "global", "open", "quick", "regional", "shared", "steady", "timely")
NOUNS = ("markets", "networks", "orders", "payments", "records", "reports", "services", "teams")


def closest_vocabulary(column: str) -> str | None:
    """The vocabulary whose name is most like the column's, if close enough."""
    scored = [
        (SequenceMatcher(a=column.upper(), b=name.upper()).ratio(), name) for name in VOCABULARIES
    ]
    ratio, name = max(scored, key=lambda pair: pair[0])
    return name if ratio > SIMILAR else None


def _hash(
    row_id: Column, column: str, seed: int, part: int | None = 0, start: int = 0, digits: int = 15
) -> Column:
    """The number that some of the 32 hexadecimal digits of an MD5 stand for.

    It is that of row, column, seed and part, joined by bars; without a part, of the others.
    """
    rest = f"{column}|{seed}" if part is None else f"{column}|{seed}|{part}"
    name = F.concat_ws("|", row_id.cast("string"), F.lit(rest))
    return F.conv(F.substring(F.md5(name.cast("binary")), start + 1, digits), 16, 10).cast("bigint")


def _choice(words: tuple[str, ...], hashed: Column) -> Column:
    return F.element_at(
        F.array(*[F.lit(w) for w in words]), (F.pmod(hashed, F.lit(len(words))) + 1).cast("int")
    )


def _code(hashed: Column) -> Column:
    """Ten characters of A-Z and 0-9: the hash in base 36."""
    return F.lpad(F.conv(F.pmod(hashed, F.lit(CODES)).cast("string"), 10, 36), CODE_LENGTH, "0")


def _digits(hashed: Column, count: int) -> Column:
    return F.lpad(F.pmod(hashed, F.lit(10**count)).cast("string"), count, "0")


def _text_value(name: str, row_id: Column, seed: int, one_digest: bool) -> Column:
    upper = name.upper()

    def hashed(part: int, digits: int) -> Column:
        if one_digest:
            return _hash(row_id, name, seed, None, digits * part, digits)
        return _hash(row_id, name, seed, part)

    def phrase(nth: int) -> Column:
        kinds = enumerate((VERBS, QUALITIES, NOUNS), 3 * nth)
        return F.concat_ws(" ", *[_choice(words, hashed(i, 3)) for i, words in kinds])

    if "COMPANY" in upper:
        return phrase(0)
    if "PHONE" in upper:
        return F.concat_ws("-", *[_digits(hashed(i, 8), n) for i, n in enumerate((3, 3, 4))])
    if "COMMENT" in upper or "DESCRIPTION" in upper:
        return F.concat_ws(" ", *[F.concat(F.initcap(phrase(i)), F.lit(".")) for i in range(3)])
    return _code(hashed(0, 15))


def column_value(
    column: DeclaredColumn,
    row_id: Column,
    limit: Column,
    seed: int,
    now: Column,
    one_digest: bool = False,
) -> Column:
    """The generated value of one column, in the column's declared type."""
    hashed = _hash(row_id, column.name, seed, None if one_digest else 0)
    if column.name == "ts":
        text = column.type_name == "STRING"
        return (now.cast("string") if text else epoch_millis(now)).cast(column.spark_type)
    words = closest_vocabulary(column.name)
    if words is not None:
        return _choice(VOCABULARIES[words], hashed).cast(column.spark_type)
    match column.type_name:
        case "INT" | "INTEGER":
            value = F.pmod(hashed, limit.cast("bigint") + 1)
        case "DOUBLE" | "FLOAT":
            unit = F.pmod(hashed, F.lit(FRACTIONS)) / float(FRACTIONS)
            value = F.lit(DOUBLE_LOW) + unit * (DOUBLE_HIGH - DOUBLE_LOW)
        case "STRING":
            value = _text_value(column.name, row_id, seed, one_digest)
        case "TIMESTAMP" | "DATE":
            value = now
        case "TIME":
            value = F.date_format(now, "HH:mm:ss.SSSSSS")
        case "LONG":
            value = epoch_millis(now)
        case _:
            value = F.lit("unknown")
    return value.cast(column.spark_type)


def generate_for(
    ids: DataFrame,
    table: DeclaredTable,
    *,
    row_id: str = "id",
    limit: int = DEFAULT_ROWS,
    seed: int = 0,
    now: Column | None = None,
    one_digest: bool = False,
) -> DataFrame:
    """One row of ``table`` for every id; integers lie in 0..limit.

    Each word and group of digits of a text has an MD5 of its own. With ``one_digest`` they
    are different digits of one MD5, 3 for a word, which gives other values.
    """
    moment = F.current_timestamp() if now is None else now
    return ids.select(
        *[
            column_value(c, F.col(row_id), F.lit(limit), seed, moment, one_digest).alias(c.name)
            for c in table.columns
        ]
    )


def generate_rows(
    spark: SparkSession,
    table: DeclaredTable,
    rows: int = DEFAULT_ROWS,
    *,
    seed: int = 0,
    now: Column | None = None,
) -> DataFrame:
    return generate_for(spark.range(rows), table, limit=rows, seed=seed, now=now)


def as_records(rows: DataFrame, table: DeclaredTable) -> DataFrame:
    """Topic rows (key, value): the row's own key columns, and the row as JSON."""
    key = record_key(table.primary_keys) if table.primary_keys else F.lit("")
    return rows.select(key.alias("key"), json_record(table.column_names).alias("value"))


def write_batch_input(rows: DataFrame, job: Mapping[str, Any]) -> str:
    """Write generated rows where a batch ingest job looks for its input.

    ``job`` names ``inputDirURI`` and ``recordReaderSpec.dataFormat``; only CSV
    with a header is supported.
    """
    data_format = job["recordReaderSpec"]["dataFormat"]
    if data_format.lower() != "csv":
        raise ValueError(f"{data_format} is not supported")
    folder = job["inputDirURI"].rstrip("/")
    write_csv(rows, f"{folder}/data")
    return folder
