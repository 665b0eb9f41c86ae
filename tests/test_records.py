import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemill.functions.columns import epoch_millis, from_epoch_millis, month_key, record_key
from tidemill.operators import records, relational

TRIP_COLUMNS = [
    "VendorID", "tpep_pickup_datetime", "passenger_count", "trip_distance",
    "PULocationID", "DOLocationID", "payment_type", "total_amount",
]


@pytest.fixture(scope="module")
def trips(spark):
    rows = [
        ("1", "2031-02-03 04:05:06", "3", "2.25", "11", "12", "2", "6.5"),
        ("2", "2031-02-03 05:06:07", "4", "7.75", "13", "14", "1", "-8.25"),
    ]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in TRIP_COLUMNS))


def test_ride_records_round_trip(trips):
    rides = records.ride_rows(trips, F.col("tpep_pickup_datetime"))
    assert rides.columns == records.RIDE_SCHEMA.fieldNames()
    topic = records.to_topic_rows(rides, ["vendorId"], rides.columns)
    first = topic.orderBy("key").collect()[0]
    assert json.loads(first["key"]) == {"vendorId": 1}
    assert list(json.loads(first["value"])) == rides.columns
    decoded = records.from_topic_rows(topic, records.RIDE_SCHEMA)
    assert decoded.collect() == rides.collect()


def test_nulls_stay_in_the_json(spark):
    df = spark.createDataFrame([(1, None)], "k int, v string")
    value = records.to_topic_rows(df, ["k"], ["k", "v"]).collect()[0]["value"]
    assert json.loads(value) == {"k": 1, "v": None}


def test_bad_number_raises_under_ansi(trips):
    broken = trips.withColumn("total_amount", F.lit("much"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        records.ride_rows(broken, F.lit("now")).collect()


@pytest.mark.parametrize(
    "bad", ['{"k": 1, "v": "1.0', '{"k": "x", "v": 1.0}', '{"k": 1, "v": 123456.789}', '{"k": 99999999999}']
)
def test_bad_values_raise(spark, bad):
    schema = spark.createDataFrame([], "k int, v decimal(5,2)").schema
    topic = spark.createDataFrame([('{"k": 1, "v": 2.5}',), (bad,)], "value string")
    good = records.from_topic_rows(topic.limit(1), schema).collect()[0]
    assert (good["k"], str(good["v"])) == (1, "2.50")
    with pytest.raises(Exception, match="MALFORMED|CANNOT_PARSE|PARSE"):
        records.from_topic_rows(topic, schema).collect()


def test_clean_captions(spark):
    rows = [
        (1, " ".join(["w"] * 49), "2024-01-02 03:04:05"),
        (2, " ".join(["w"] * 50), "2024-01-02 03:04:05"),
        (3, " ".join(["w"] * 51), "2024-01-02 03:04:05"),
        (4, "a  b ", "yesterday"),
        (5, None, "2024-01-02 03:04:05"),
    ]
    df = spark.createDataFrame(rows, "_id int, caption string, created_time string")
    cleaned = {r["caption"]: r for r in records.clean_captions(df).collect()}
    assert set(cleaned) == {rows[0][1], "a  b "}
    assert cleaned["a  b "]["caption_size"] == 4
    assert cleaned["a  b "]["created_time"] is None
    assert cleaned[rows[0][1]]["created_time"] == datetime(2024, 1, 2, 3, 4, 5)
    assert records.clean_captions(df).columns == ["caption", "created_time", "caption_size"]


def test_epoch_millis_rounds_down(spark):
    df = spark.createDataFrame(
        [("1969-12-31 23:59:59.999500",), ("2024-01-01 00:00:00.001999",)], "t string"
    ).select(F.col("t").cast("timestamp").alias("t"))
    got = [r[0] for r in df.select(epoch_millis("t")).collect()]
    assert got == [-1, 1704067200001]
    back = df.select(from_epoch_millis(epoch_millis("t")).cast("string")).collect()
    assert back[1][0] == "2024-01-01 00:00:00.001"


def test_small_column_functions(spark):
    df = spark.createDataFrame([(1, "x", datetime(2024, 3, 9))], "a int, b string, t timestamp_ntz")
    assert df.select(record_key(["a", "b"])).collect()[0][0] == "1-x"
    assert df.select(month_key("t")).collect()[0][0] == "2024-03"


def test_filters_and_sorts(spark):
    df = spark.createDataFrame([("Emma", 3), ("bob", 1), ("DEAN", 2)], "name string, n int")
    assert {r["name"] for r in relational.filter_matching(df, "name", "E").collect()} == {"Emma", "DEAN"}
    mapped = relational.upper_and_double(df, "name", "n").orderBy("n").collect()
    assert tuple(mapped[0]) == ("BOB", 1.0)
    assert [r["n"] for r in relational.top_rows(df, [F.desc("n")], 2).collect()] == [3, 2]
    assert relational.fold_any([]) is not None and relational.fold_all([]) is not None


def test_join_without_clash_can_be_saved(spark, tmp_path):
    left = spark.createDataFrame([(1, 5, 9)], "rental_id int, staff_id int, amount int")
    right = spark.createDataFrame([(1, 6, 7), (1, 6, 7)], "rental_id int, staff_id int, customer_id int")
    joined = relational.join_distinct(left.unionAll(left), right, ["rental_id"], "rental_")
    assert joined.columns == ["rental_id", "staff_id", "amount", "rental_staff_id", "customer_id"]
    joined.write.parquet(str(tmp_path / "joined"))
    assert joined.count() == 1
