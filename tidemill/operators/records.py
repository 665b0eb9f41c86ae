"""Rows to keyed JSON records and back; cleaning of caption documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.columns import json_record, parse_moment, space_tokens

# The fields of a ride record, in the order of its JSON object.
RIDE_SCHEMA = T.StructType(
    [
        T.StructField("vendorId", T.IntegerType()),
        T.StructField("passenger_count", T.IntegerType()),
        T.StructField("trip_distance", T.DoubleType()),
        T.StructField("pickup_location", T.IntegerType()),
        T.StructField("dropoff_location", T.IntegerType()),
        T.StructField("payment_type", T.IntegerType()),
        T.StructField("total_amount", T.DoubleType()),
        T.StructField("pickup_datetime", T.StringType()),
    ]
)

# Where the numeric ride fields come from in a trip file.
RIDE_SOURCE = {
    "vendorId": "VendorID",
    "passenger_count": "passenger_count",
    "trip_distance": "trip_distance",
    "pickup_location": "PULocationID",
    "dropoff_location": "DOLocationID",
    "payment_type": "payment_type",
    "total_amount": "total_amount",
}


def ride_rows(trips: DataFrame, pickup: Column, source: Mapping[str, str] = RIDE_SOURCE) -> DataFrame:
    """Pick and cast the ride fields of trips read as text columns.

    ``pickup`` is the pickup time to record: the time of sending for a live
    feed, the source column for a replay.
    """
    fields = [
        F.col(source[f.name]).cast(f.dataType).alias(f.name)
        for f in RIDE_SCHEMA.fields
        if f.name in source
    ]
    return trips.select(*fields, pickup.cast("string").alias("pickup_datetime"))


def to_topic_rows(df: DataFrame, key: Sequence[str], value: Sequence[str]) -> DataFrame:
    """Topic rows: JSON text of the key columns and of the value columns."""
    return df.select(json_record(key).alias("key"), json_record(value).alias("value"))


def from_topic_rows(topic: DataFrame, schema: T.StructType, *keep: str) -> DataFrame:
    """Values as columns in the order of ``schema``; ``keep`` passes columns on.

    A value that can't be read, or a number that doesn't fit its type, raises.
    """
    text = F.col("value").cast("string")
    parsed = topic.select(*keep, F.from_json(text, schema, {"mode": "FAILFAST"}).alias("_value"))
    return parsed.select(*keep, "_value.*")


def clean_captions(documents: DataFrame, max_tokens: int = 50) -> DataFrame:
    """Parse the time, count caption tokens, drop ``_id``, keep short captions.

    An unreadable time becomes null. A null caption has a null size and is
    dropped by the size filter.
    """
    return (
        documents.withColumns(
            {
                "created_time": parse_moment("created_time"),
                "caption_size": F.size(space_tokens("caption")),
            }
        )
        .drop("_id")
        .filter(F.col("caption_size") < max_tokens)
    )
