"""What the physical plans have to look like."""

import pytest
from pyspark.sql import functions as F

from tidemill.operators import warehouse, windows
from tidemill.plans import PLANS
from tidemill.plans.relational import customers, payments, rentals


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = plan_of(PLANS["filter_sorted"].run(spark, sf_dir))
    assert "EqualTo(c_mktsegment,BUILDING)" in plan
    assert "c_acctbal" not in plan


def test_top_rows_is_one_ordered_take(spark, sf_dir):
    plan = plan_of(PLANS["top_rows"].run(spark, sf_dir))
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


@pytest.mark.parametrize("name", ["wordcount", "sum_by_key", "avg_by_key", "group_count_max"])
def test_aggregates_combine_before_the_shuffle(spark, sf_dir, name):
    assert "partial_" in plan_of(PLANS[name].run(spark, sf_dir))


def test_recency_combines_before_each_join(spark, sf_dir, no_broadcast):
    plan = plan_of(
        windows.activity_recency(
            customers(spark, sf_dir), rentals(spark, sf_dir), payments(spark, sf_dir)
        )
    )
    assert "Window" not in plan
    assert "partial_sum(amount" in plan and "partial_sum(_sum" in plan


@pytest.mark.parametrize("name", ["moving_avg_rows", "moving_avg_rows_by_key"])
def test_row_frames_are_cut_into_ranges(spark, sf_dir, name):
    """Only the row per range, not the rows, meets in a single task."""
    plan = plan_of(PLANS[name].run(spark, sf_dir))
    assert plan.count("SinglePartition") == 1
    single = plan[plan.index("SinglePartition") :].splitlines()[1]
    assert "ObjectHashAggregate(keys=[_range" in single
    assert "WindowGroupLimit" in plan


def test_share_without_hot_groups_shuffles_once(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_totalprice")
    plan = plan_of(windows.share_of_group(df, ["o_custkey"], "o_totalprice"))
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1


def test_type_one_changes_take_one_join(spark, sf_dir, no_broadcast):
    plan = plan_of(PLANS["scd1_find"].run(spark, sf_dir))
    assert plan.count("SortMergeJoin") == 1 and plan.count("Exchange") == 2


def test_no_python_in_the_plans(spark, sf_dir):
    for name in ("wordcount", "customer_recency", "moving_avg_rows", "scd1_find", "generate_table"):
        plan = plan_of(PLANS[name].run(spark, sf_dir))
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_a_small_source_is_broadcast_to_the_target(spark, sf_dir):
    target = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    source = target.where(F.col("o_custkey") == 5)
    plan = plan_of(warehouse.upsert(target, source, ["o_orderkey"], latest_by="o_custkey"))
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan
