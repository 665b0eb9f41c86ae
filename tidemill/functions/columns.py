"""Column expressions the jobs share. All are built-in Spark expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_MILLI = 1000


def money(value: Column | str, precision: int = 12, scale: int = 2) -> Column:
    """Amounts as decimals, so that sums do not depend on the order of rows."""
    return _col(value).cast(f"decimal({precision},{scale})")


def mean_of(total: Column, count: Column) -> Column:
    """Total over count as a double; null where nothing was counted."""
    return F.try_divide(total.cast("double"), count.cast("double"))


def full_name(first: Column | str, last: Column | str) -> Column:
    return F.concat(_col(first), F.lit(" "), _col(last))


def month_key(moment: Column | str) -> Column:
    return F.date_format(_col(moment), "yyyy-MM")


def percent_of(part: Column, total: Column, digits: int = 2) -> Column:
    """part * 100 / total, rounded; null where the total is zero."""
    return F.round(F.try_divide((part * 100).cast("double"), total.cast("double")), digits)


def space_tokens(text: Column | str) -> Column:
    """Split at single spaces; empty tokens stay."""
    return F.split(_col(text), " ")


def whitespace_tokens(text: Column | str) -> Column:
    return F.split(_col(text), r"\s")


def parse_moment(text: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Timestamp, or null where the text does not follow the pattern."""
    return F.try_to_timestamp(_col(text), F.lit(pattern))


def epoch_millis(moment: Column | str) -> Column:
    """Milliseconds since the epoch, rounded down."""
    micros = F.unix_micros(_col(moment).cast("timestamp"))
    return ((micros - F.pmod(micros, F.lit(MICROS_PER_MILLI))) / MICROS_PER_MILLI).cast("bigint")


def from_epoch_millis(millis: Column | str) -> Column:
    return F.timestamp_millis(_col(millis))


def record_key(columns: Sequence[str]) -> Column:
    """The key columns of one row, joined by dashes."""
    return F.concat_ws("-", *[F.col(c).cast("string") for c in columns])


def json_record(columns: Sequence[str]) -> Column:
    """The named columns as one flat JSON object."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
