"""Hot keys: results do not change, and the hot rows are spread."""

import math

import pytest
from pyspark.sql import functions as F

from tidemill.operators.skew import PIECE, SkewRule, hot_keys, spread_join, with_piece

RULE = SkewRule(min_rows=0, share=0.05)


@pytest.fixture(scope="module")
def skewed(spark):
    """9000 rows: a third has key 0, a ninth has no key, the others are spread."""
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 9 == 1, None).otherwise(F.col("id") % 700)
    return spark.range(9000).select(key.alias("k"), F.col("id").alias("v"))


@pytest.fixture(scope="module")
def lookup(spark):
    return spark.range(650).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))


def rows(df):
    return sorted(df.collect(), key=str)


def test_hot_keys_finds_the_large_keys_only(skewed):
    found = {r["k"]: r["_pieces"] for r in hot_keys(skewed, ["k"], RULE).collect()}
    assert set(found) == {0, None}
    assert found[0] >= 6


def test_no_hot_keys_in_small_or_even_tables(spark, skewed):
    assert hot_keys(skewed, ["k"]) is None
    assert hot_keys(spark.range(1000), ["id"], RULE) is None


def test_sampled_hot_keys_stay_bounded(spark):
    many = spark.range(200_000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k")
    )
    found = hot_keys(many, ["k"], SkewRule(min_rows=0, share=0.01)).collect()
    assert -1 in {r["k"] for r in found}
    assert len(found) <= 100


def test_pieces_spread_the_hot_key_only(skewed):
    hot = hot_keys(skewed, ["k"], RULE)
    pieces = with_piece(skewed, ["k"], hot, ["v"])
    largest = pieces.groupBy("k", PIECE).count().agg(F.max("count")).collect()[0][0]
    assert largest < 3000 / 4
    others = pieces.where("k <> 0").agg(F.max(PIECE)).collect()[0][0]
    assert others == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_spread_join_equals_plain_join(spark, skewed, lookup, how, null_safe):
    hot = hot_keys(skewed, ["k"], RULE)
    plain = spread_join(skewed, lookup, ["k"], how, null_safe=null_safe)
    spread = spread_join(skewed, lookup, ["k"], how, hot=hot, spread_by=["v"], null_safe=null_safe)
    assert plain.columns == spread.columns
    assert rows(plain) == rows(spread)


def test_spread_join_keeps_repeated_matches(skewed, lookup):
    twice = lookup.unionAll(lookup)
    hot = hot_keys(skewed, ["k"], RULE)
    plain = skewed.join(twice, ["k"])
    assert rows(plain) == rows(spread_join(skewed, twice, ["k"], hot=hot))


def test_spread_join_refuses_other_joins(skewed, lookup):
    with pytest.raises(ValueError):
        spread_join(skewed, lookup, ["k"], "full")


def test_aqe_splits_a_plain_join_on_a_hot_key(spark):
    """The row-level joins are plain sort-merge joins, which AQE can split."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        left = spark.range(0, 200_000, 1, 16).select(
            F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id"
        )
        right = spark.range(0, 200_000, 1, 4).select(F.col("id").alias("k"), (F.col("id") + 1).alias("w"))
        joined = spread_join(left, right, ["k"])
        assert len(joined.collect()) == 200_000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in settings:
            spark.conf.unset(name)
