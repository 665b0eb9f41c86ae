from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.functions.columns import money
from tidemill.operators import aggregates, ranges


def test_word_count_keeps_empty_tokens_and_sorts_descending(spark):
    lines = spark.createDataFrame([("a  b ",), ("b a",), ("",), (None,)], "text string")
    counted = [tuple(r) for r in aggregates.word_count(lines).collect()]
    assert counted == [("b", 2), ("a", 2), ("", 3)]


def test_word_count_agrees_with_the_key_value_formulation(spark):
    texts = ["to be or not to be", "", "be  quick"]
    lines = spark.createDataFrame([(t,) for t in texts], "text string")
    counted = {r["word"]: r["count"] for r in aggregates.word_count(lines).collect()}
    by_key = dict(
        spark.sparkContext.parallelize(texts)
        .flatMap(lambda line: line.split(" "))
        .map(lambda word: (word, 1))
        .reduceByKey(lambda a, b: a + b)
        .collect()
    )
    assert counted == by_key


@pytest.mark.parametrize("partitions", [1, 2, 3, 8])
def test_mean_is_the_same_at_any_partitioning(spark, partitions):
    rows = [("Alice", 20), ("Alice", 21), ("Alice", 25), ("Bob", 30), ("Alice", 38), ("Cy", None)]
    df = spark.createDataFrame(rows, "name string, age int").repartition(partitions)
    means = dict(map(tuple, aggregates.mean_by_key(df, "name", F.col("age"), "mean").collect()))
    assert means == {"Alice": 26.0, "Bob": 30.0, "Cy": None}


@settings(max_examples=10, deadline=None)
@given(
    st.lists(
        st.tuples(st.sampled_from("abc"), st.integers(-10_000, 10_000)), min_size=1, max_size=40
    ),
    st.integers(1, 6),
)
def test_mean_property(spark, rows, partitions):
    df = spark.createDataFrame(rows, "k string, v int").repartition(partitions)
    means = dict(map(tuple, aggregates.mean_by_key(df, "k", F.col("v"), "mean").collect()))
    wanted = defaultdict(list)
    for k, v in rows:
        wanted[k].append(v)
    assert means == {k: sum(v) / len(v) for k, v in wanted.items()}


def test_sum_and_total_are_exact_decimals(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("b", 5.0)], "k string, v double")
    sums = {r["k"]: str(r["s"]) for r in aggregates.sum_by_key(df, "k", money("v"), "s").collect()}
    assert sums == {"a": "0.30", "b": "5.00"}
    assert str(aggregates.total(df, money("v"), "t").collect()[0][0]) == "5.30"


def skewed_values(spark, copies: bool):
    value = F.col("id") % 5 if copies else F.col("id")
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50))
    return spark.range(3000).select(key.alias("k"), value.alias("v"), F.col("id").alias("n"))


@pytest.mark.parametrize("copies", [False, True])
@pytest.mark.parametrize("rows_per_range", [50, 200_000])
def test_collect_by_key_pages_by_rank_and_keeps_all_values(spark, monkeypatch, copies, rows_per_range):
    monkeypatch.setattr(ranges, "ROWS_PER_RANGE", rows_per_range)
    df = skewed_values(spark, copies)
    lists = aggregates.collect_by_key(df, "k", "v", key_name="k", page_size=100).collect()
    wanted = defaultdict(list)
    for r in df.collect():
        wanted[r["k"]].append(r["v"])
    pages = {}
    for k, values in wanted.items():
        values.sort()
        for at in range(0, len(values), 100):
            pages[k, at // 100] = values[at : at + 100]
    assert {(r["k"], r["piece"]): r["values"] for r in lists} == pages
    assert len(lists) == len(pages)


def test_collect_by_key_of_a_key_with_more_than_one_page_of_the_default_size(spark):
    df = spark.range(250_001).select(F.lit("hot").alias("k"), F.col("id").alias("v"))
    lists = aggregates.collect_by_key(df, "k", "v")
    got = lists.select("piece", F.size("values"), F.array_min("values")).collect()
    assert sorted(map(tuple, got)) == [(0, 100_000, 0), (1, 100_000, 100_000), (2, 50_001, 200_000)]


def test_collect_by_key_with_one_list_per_key(spark):
    df = spark.createDataFrame(
        [("a", 3), ("a", 1), (None, 2), ("b", 1), ("b", None), ("c", None)], "k string, v int"
    )
    lists = {r["key"]: (r["piece"], r["values"]) for r in aggregates.collect_by_key(df, "k", "v").collect()}
    assert lists == {"a": (0, [1, 3]), "b": (0, [1]), None: (0, [2]), "c": (0, [])}


def test_group_by_expression(spark):
    df = spark.createDataFrame([(20,), (21,), (24,), (33,)], "age int")
    lists = aggregates.collect_by_key(df, F.col("age") % 2, "age", key_name="odd")
    assert {r["odd"]: r["values"] for r in lists.collect()} == {0: [20, 24], 1: [21, 33]}


def test_table_profile_counts_rows_and_columns(spark):
    profile = aggregates.table_profile({"a": spark.range(5), "b": spark.range(0)})
    assert {tuple(r) for r in profile.collect()} == {("a", 5, 1), ("b", 0, 1)}
