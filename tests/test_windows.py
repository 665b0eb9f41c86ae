import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill.operators import windows
from tidemill.operators import ranges as ranges_module
from tidemill.operators.ranges import MAX_RANGES, RANGE, find_ranges, with_range
from tidemill.operators.skew import SkewRule, hot_keys

RULE = SkewRule(min_rows=0, share=0.05)
START = datetime(2024, 1, 1)


def payments(spark, rows=600, hot_day=True, seed=3):
    """id, customer, moment, amount; a third of the rows on one day and customer."""
    rng = random.Random(seed)
    data = []
    for i in range(rows):
        hot = hot_day and i % 3 == 0
        day = 40 if hot else rng.randrange(90)
        customer = 0 if hot else rng.randrange(20)
        data.append((i, customer, START + timedelta(days=day), rng.randrange(1000)))
    schema = "id long, customer long, moment timestamp_ntz, amount long"
    return spark.createDataFrame(data, schema), data


def brute_rows(data, by_customer: bool, preceding: int):
    groups = {}
    for row in sorted(data, key=lambda r: (r[2], r[0])):
        groups.setdefault(row[1] if by_customer else None, []).append(row)
    answer = {}
    for rows in groups.values():
        for i, row in enumerate(rows):
            frame = rows[max(0, i - preceding) : i + 1]
            answer[row[0]] = sum(r[3] for r in frame) / len(frame)
    return answer


@pytest.mark.parametrize("min_ranges", [1, 2, 7, 64, 600])
@pytest.mark.parametrize("by_customer", [False, True])
def test_moving_average_rows_equals_brute_force(spark, min_ranges, by_customer):
    df, data = payments(spark)
    averaged = windows.moving_average_rows(
        df,
        "amount",
        ["moment", "id"],
        partition_by=["customer"] if by_customer else [],
        min_ranges=min_ranges,
    )
    assert averaged.columns == [*df.columns, "moving_avg"]
    got = {r["id"]: r["moving_avg"] for r in averaged.collect()}
    assert got == brute_rows(data, by_customer, 7)


@pytest.mark.parametrize("samples", [1, 3, 9, 20])
def test_moving_average_rows_with_a_thin_sample(spark, monkeypatch, samples):
    """Ranges with few sampled rows, and late keys taken from a real sample."""
    monkeypatch.setattr(ranges_module, "SAMPLES_PER_RANGE", samples)
    df, data = payments(spark, rows=2000)
    averaged = windows.moving_average_rows(df, "amount", ["moment", "id"], min_ranges=12)
    assert {r["id"]: r["moving_avg"] for r in averaged.collect()} == brute_rows(data, False, 7)


def test_late_keys_leave_enough_rows(spark):
    df, _ = payments(spark, rows=3000)
    found = find_ranges(df, ["moment", "id"], min_ranges=5)
    assert len(found.sampled) == len(found.bounds) + 1
    assert found.late_keys(7) == [keys[-7] for keys in found.sampled]
    assert set(found.late_keys(10**6)) == {"null"}


def test_frame_longer_than_many_ranges(spark):
    df, data = payments(spark, rows=60)
    averaged = windows.moving_average_rows(
        df, "amount", ["moment", "id"], preceding=25, min_ranges=60
    )
    assert {r["id"]: r["moving_avg"] for r in averaged.collect()} == brute_rows(data, False, 25)


def test_ranges_cut_a_hot_day(spark):
    """The whole sort key is cut, so a day with a third of the rows is too."""
    df, _ = payments(spark, rows=3000)
    order = ["moment", "id"]
    bounds = find_ranges(df, order, min_ranges=30).bounds
    assert len(bounds) <= 30 <= MAX_RANGES
    sizes = [r["count"] for r in with_range(df, order, bounds).groupBy(RANGE).count().collect()]
    assert sum(sizes) == 3000
    assert max(sizes) < 3000 / 30 * 3


def test_range_numbers_follow_the_order(spark):
    df, data = payments(spark, rows=200)
    order = ["moment", "id"]
    numbered = with_range(df, order, find_ranges(df, order, min_ranges=9).bounds)
    ranges = [r[RANGE] for r in numbered.orderBy(*order).collect()]
    assert ranges == sorted(ranges)
    assert len(set(ranges)) > 5


@pytest.mark.parametrize(
    "kind",
    ["date", "timestamp", "timestamp_ntz", "string", "double", "float", "decimal(20,3)", "int"],
)
def test_ranges_of_every_kind_of_key(spark, kind):
    """Also with null keys, which come first."""
    n = F.when(F.col("id") % 10 != 0, F.col("id"))
    at = F.timestamp_micros(n * 86_400_123_457)
    value = at if kind.startswith(("date", "timestamp")) else n * 1.5
    df = spark.range(500).select(value.cast(kind).alias("k"), "id")
    bounds = find_ranges(df, ["k", "id"], min_ranges=12).bounds
    assert len(bounds) == 11
    ranges = [r[RANGE] for r in with_range(df, ["k", "id"], bounds).orderBy("k", "id").collect()]
    assert ranges == sorted(ranges)
    assert set(ranges) == set(range(12))


def test_moving_average_rows_of_nothing(spark):
    df, _ = payments(spark, rows=3)
    assert windows.moving_average_rows(df.limit(0), "amount", ["moment", "id"]).count() == 0


def test_moving_average_ignores_null_amounts(spark):
    df = spark.createDataFrame([(1, None), (2, 4), (3, 6)], "id int, amount int")
    got = [r["moving_avg"] for r in windows.moving_average_rows(df, "amount", ["id"]).orderBy("id").collect()]
    assert got == [None, 4.0, 5.0]


@pytest.mark.parametrize("by_customer", [False, True])
@pytest.mark.parametrize("use_hot", [False, True])
def test_moving_average_days_equals_brute_force(spark, by_customer, use_hot):
    df, data = payments(spark, rows=300)
    partition = ["customer"] if by_customer else []
    hot = None
    if use_hot:
        hot = hot_keys(df.withColumn("_day", F.to_date("moment")), [*partition, "_day"], RULE)
        assert hot is not None
    averaged = windows.moving_average_days(df, "amount", "moment", partition_by=partition, hot=hot)
    got = {r["id"]: r["moving_avg"] for r in averaged.collect()}
    wanted = {}
    for row in data:
        frame = [
            r[3]
            for r in data
            if timedelta(0) <= row[2] - r[2] <= timedelta(days=6)
            and (not by_customer or r[1] == row[1])
        ]
        wanted[row[0]] = sum(frame) / len(frame)
    assert got == wanted


@pytest.mark.parametrize("use_hot", [False, True])
def test_share_of_group(spark, use_hot):
    df, data = payments(spark, rows=300)
    df = df.withColumn("customer", F.when(F.col("customer") != 7, F.col("customer")))
    hot = hot_keys(df, ["customer"], RULE) if use_hot else None
    shares = windows.share_of_group(df, ["customer"], "amount", "share", hot=hot, spread_by=["id"])
    totals = {}
    for r in data:
        totals[r[1]] = totals.get(r[1], 0) + r[3]
    got = {r["id"]: r["share"] for r in shares.collect()}
    assert len(got) == 300
    for r in data:
        assert got[r[0]] == pytest.approx(r[3] * 100 / totals[r[1]], abs=0.0051)


def test_share_of_a_zero_total_is_null(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", -5.0), ("b", 3.0)], "k string, v double")
    got = sorted(map(tuple, windows.share_of_group(df, ["k"], "v", "share").collect()), key=str)
    assert got == [("a", -5.0, None), ("a", 5.0, None), ("b", 3.0, 100.0)]


def test_activity_recency_equals_windows_over_joined_rows(spark):
    customer = spark.createDataFrame(
        [(1, "A", "X"), (1, "A", "X"), (1, "B", "Y"), (2, "C", "Z"), (3, "D", "W")],
        "customer_id int, first_name string, last_name string",
    )
    rental = spark.createDataFrame(
        [(10, 1, "2024-01-01"), (11, 1, "2024-01-05"), (12, 2, "2024-02-01"), (13, 1, "2024-03-01")],
        "rental_id int, customer_id int, rental_date string",
    ).withColumn("rental_date", F.col("rental_date").cast("date"))
    payment = spark.createDataFrame(
        [(10, 5), (10, 7), (11, None), (12, 3)], "rental_id int, amount int"
    )
    got = sorted(map(tuple, windows.activity_recency(customer, rental, payment).collect()))
    assert got == [(1, "A X", 4, 6.0), (1, "B Y", 4, 6.0), (2, "C Z", 0, 3.0)]
