"""Every registered query against its SQL on the given tables."""

import oracle
import pytest
from pyspark.sql import functions as F

from tidemill.operators import skew
from tidemill.operators import warehouse as operators
from tidemill.plans import PLANS, relational, warehouse


@pytest.fixture(scope="module")
def connection(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", [n for n, p in PLANS.items() if p.sql])
def test_query_agrees_with_sql(spark, sf_dir, connection, name):
    plan = PLANS[name]
    assert oracle.difference(plan.run(spark, sf_dir), connection, plan.sql) is None


SPREAD = [
    "join_inner", "join_three_way", "pct_of_month", "join_right_suffix",
    "scd1_find", "keyed_update_spread", "scd2_apply_spread",
]


@pytest.mark.parametrize("name", SPREAD)
def test_spreading_hot_keys_changes_nothing(spark, sf_dir, connection, monkeypatch, name):
    """The same queries with hundreds of keys, unique or not, taken for hot."""
    found = []

    def many_hot_keys(df, keys):
        some = df.select(*keys).distinct().withColumn(skew.PIECES, F.lit(3)).limit(400)
        found.append(spark.createDataFrame(some.collect(), some.schema))
        return found[-1]

    for module in (relational, warehouse, operators):
        monkeypatch.setattr(module, "hot_keys", many_hot_keys)
    plan = PLANS[name]
    assert oracle.difference(plan.run(spark, sf_dir), connection, plan.sql) is None
    assert found and all(hot.count() == 400 for hot in found)


def test_entry_gives_rows(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["customer_id", "full_name", "recency", "avg_amount"]
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
