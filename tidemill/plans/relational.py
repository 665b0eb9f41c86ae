"""Projections, filters, joins, aggregates and windows over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.columns import epoch_millis, from_epoch_millis, full_name, money, month_key
from tidemill.operators import aggregates, relational, windows
from tidemill.operators.skew import hot_keys, spread_join
from tidemill.plans.registry import TABLES, plan, table


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        (F.col("c_acctbal") > 0).cast("int").alias("active"),
        F.col("c_name").alias("first_name"),
        F.col("c_mktsegment").alias("last_name"),
    )


def rentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("rental_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("rental_date"),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("rental_id"),
        money("l_extendedprice").alias("amount"),
        F.col("l_shipdate").alias("payment_date"),
    )


@plan("SELECT c_custkey, c_name, c_nationkey FROM customer")
def select_columns(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")


@plan(
    """SELECT c_custkey, c_name, c_nationkey FROM customer
    WHERE c_mktsegment = 'BUILDING' ORDER BY c_nationkey, c_custkey"""
)
def filter_sorted(spark, sf_dir):
    kept = relational.filter_equal_sorted(
        table(spark, sf_dir, "customer"), "c_mktsegment", "BUILDING", "c_nationkey", ["c_custkey"]
    )
    return kept.select("c_custkey", "c_name", "c_nationkey")


@plan(
    """SELECT o_orderkey, o_custkey, o_orderdate FROM orders
    ORDER BY o_orderdate DESC, o_custkey ASC, o_orderkey"""
)
def sort_mixed(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return relational.sort_mixed(rows, "o_orderdate", "o_custkey", ["o_orderkey"])


@plan(
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"""
)
def top_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return relational.top_rows(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], 20)


@plan(
    "SELECT c_custkey, concat(c_name, ' ', c_mktsegment) AS full_name FROM customer",
    name="full_name",
)
def full_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", full_name("c_name", "c_mktsegment").alias("full_name")
    )


@plan("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)E')")
def filter_regex(spark, sf_dir):
    return relational.filter_matching(
        table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "E"
    )


@plan("SELECT upper(p_name) AS p_name, CAST(p_size AS DOUBLE) AS p_size FROM part")
def map_rows(spark, sf_dir):
    return relational.upper_and_double(table(spark, sf_dir, "part"), "p_name", "p_size")


@plan(
    """SELECT word, count(*) AS "count"
    FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents)
    GROUP BY word ORDER BY word DESC"""
)
def wordcount(spark, sf_dir):
    return aggregates.word_count(table(spark, sf_dir, "documents"))


@plan(
    """SELECT c_nationkey, count(c_custkey) AS quantity, max(c_acctbal) AS largest_balance
    FROM customer GROUP BY c_nationkey"""
)
def group_count_max(spark, sf_dir):
    return aggregates.count_and_max(
        table(spark, sf_dir, "customer"),
        "c_nationkey",
        "c_custkey",
        "c_acctbal",
        ("quantity", "largest_balance"),
    )


@plan(
    """SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS total
    FROM lineitem GROUP BY l_suppkey"""
)
def sum_by_key(spark, sf_dir):
    summed = aggregates.sum_by_key(
        table(spark, sf_dir, "lineitem"), "l_suppkey", money("l_extendedprice"), "total"
    )
    return summed.withColumn("total", F.col("total").cast("double"))


@plan(
    """SELECT o_custkey,
        CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) / count(*) AS mean_price
    FROM orders GROUP BY o_custkey"""
)
def avg_by_key(spark, sf_dir):
    return aggregates.mean_by_key(
        table(spark, sf_dir, "orders"), "o_custkey", money("o_totalprice"), "mean_price"
    )


@plan(
    """SELECT o_custkey, rank // 8 AS piece, count(*) AS n_values,
        string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS order_keys
    FROM (SELECT o_custkey, o_orderkey,
            row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rank
        FROM orders)
    GROUP BY o_custkey, rank // 8"""
)
def collect_by_key(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    lists = aggregates.collect_by_key(
        orders, "o_custkey", "o_orderkey", key_name="o_custkey", page_size=8
    )
    return lists.select(
        "o_custkey",
        "piece",
        F.size("values").cast("bigint").alias("n_values"),
        F.concat_ws(",", F.transform("values", lambda v: v.cast("string"))).alias("order_keys"),
    )


@plan(
    """SELECT odd, rank // 100 AS piece, count(*) AS n_values,
        string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS part_keys
    FROM (SELECT p_size % 2 AS odd, p_partkey,
            row_number() OVER (PARTITION BY p_size % 2 ORDER BY p_partkey) - 1 AS rank
        FROM part)
    GROUP BY odd, rank // 100"""
)
def group_by_expr(spark, sf_dir):
    lists = aggregates.collect_by_key(
        table(spark, sf_dir, "part"),
        F.col("p_size") % 2,
        "p_partkey",
        key_name="odd",
        page_size=100,
    )
    return lists.select(
        "odd",
        "piece",
        F.size("values").cast("bigint").alias("n_values"),
        F.concat_ws(",", F.transform("values", lambda v: v.cast("string"))).alias("part_keys"),
    )


@plan(
    """SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS total_sales_amount
    FROM lineitem"""
)
def total_sales(spark, sf_dir):
    summed = aggregates.total(
        table(spark, sf_dir, "lineitem"), money("l_extendedprice"), "total_sales_amount"
    )
    return summed.select(F.col("total_sales_amount").cast("double"))


@plan(
    """SELECT c_custkey AS customer_id, c_nationkey, c_name, o_orderkey AS rental_id,
        o_orderdate AS rental_date
    FROM customer JOIN orders ON o_custkey = c_custkey"""
)
def join_inner(spark, sf_dir):
    orders = rentals(spark, sf_dir)
    people = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), "c_nationkey", "c_name"
    )
    joined = spread_join(
        orders, people, ["customer_id"], hot=hot_keys(orders, ["customer_id"]), spread_by=["rental_id"]
    )
    return joined.select("customer_id", "c_nationkey", "c_name", "rental_id", "rental_date")


ACTIVITY_SQL = """SELECT c_custkey AS customer_id, CAST(c_acctbal > 0 AS INTEGER) AS active,
        concat(c_name, ' ', c_mktsegment) AS full_name, o_orderkey AS rental_id,
        o_orderdate AS rental_date, CAST(l_extendedprice AS DECIMAL(12,2)) AS amount,
        l_shipdate AS payment_date
    FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey"""


@plan(
    f"""SELECT customer_id, active, full_name, rental_id, rental_date,
        CAST(amount AS DOUBLE) AS amount, payment_date
    FROM ({ACTIVITY_SQL}) ORDER BY customer_id, rental_date, rental_id, payment_date"""
)
def join_three_way(spark, sf_dir):
    rental, payment = rentals(spark, sf_dir), payments(spark, sf_dir)
    # the join to customers is led by payments, so it is their rows that make a customer hot
    paid = payment.join(rental, on="rental_id").select("customer_id")
    rows = relational.activity(
        customers(spark, sf_dir),
        rental,
        payment,
        hot_customers=hot_keys(paid, ["customer_id"]),
        hot_rentals=hot_keys(payment, ["rental_id"]),
    )
    rows.createOrReplaceTempView("activity")
    ordered = spark.sql(
        "SELECT * FROM activity ORDER BY customer_id, rental_date, rental_id, payment_date"
    )
    return ordered.withColumn("amount", F.col("amount").cast("double"))


@plan(
    """SELECT o_orderkey AS rental_id, l_suppkey AS staff_id, l_linenumber,
        l_extendedprice AS amount, o_custkey AS customer_id,
        o_orderdate AS rental_date, o_custkey AS rental_staff_id
    FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_linenumber, l_extendedprice FROM lineitem)
    JOIN (SELECT DISTINCT o_orderkey, o_custkey, o_orderdate FROM orders) ON l_orderkey = o_orderkey"""
)
def dedup_join(spark, sf_dir):
    """Both tables are doubled first, so there are duplicate rows to remove.

    The copies come of exploding an array, which the optimizer can't see through.
    """
    payment = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("rental_id"),
        F.col("l_suppkey").alias("staff_id"),
        "l_linenumber",
        F.col("l_extendedprice").alias("amount"),
    )
    rental = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("rental_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("rental_date"),
        F.col("o_custkey").alias("staff_id"),
    )

    def doubled(df):
        copies = F.explode(F.array(F.lit(1), F.lit(2))).alias("_copy")
        # the filter keeps both copies; without it the unused column would be dropped
        return df.select("*", copies).where("_copy + rental_id <> rental_id").drop("_copy")

    return relational.join_distinct(doubled(payment), doubled(rental), ["rental_id"], "rental_")


@plan(
    """SELECT o_custkey AS customer_id, strftime(o_orderdate, '%Y-%m') AS payment_month,
        o_orderkey, round(CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 100 AS DOUBLE)
            / CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) OVER
                (PARTITION BY o_custkey, strftime(o_orderdate, '%Y-%m')) AS DOUBLE), 2)
            AS percent_in_month
    FROM orders ORDER BY o_custkey, o_orderkey"""
)
def pct_of_month(spark, sf_dir):
    payment = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("customer_id"),
        month_key("o_orderdate").alias("payment_month"),
        "o_orderkey",
        money("o_totalprice").alias("amount"),
    )
    keys = ["customer_id", "payment_month"]
    shares = windows.share_of_group(
        payment, keys, "amount", hot=hot_keys(payment, keys), spread_by=["o_orderkey"]
    )
    return shares.drop("amount").orderBy("customer_id", "o_orderkey")


@plan(
    """SELECT o_orderkey, o_orderdate,
        CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) OVER w AS DOUBLE) / count(*) OVER w
            AS moving_avg
    FROM orders
    WINDOW w AS (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"""
)
def moving_avg_rows(spark, sf_dir):
    payment = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", money("o_totalprice").alias("amount")
    )
    averaged = windows.moving_average_rows(
        payment, "amount", ["o_orderdate", "o_orderkey"], min_ranges=8
    )
    return averaged.drop("amount")


@plan(
    """SELECT o_orderkey, o_custkey, o_orderdate,
        CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) OVER w AS DOUBLE) / count(*) OVER w
            AS moving_avg
    FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
        ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"""
)
def moving_avg_rows_by_key(spark, sf_dir):
    payment = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", money("o_totalprice").alias("amount")
    )
    averaged = windows.moving_average_rows(
        payment, "amount", ["o_orderdate", "o_orderkey"], partition_by=["o_custkey"], min_ranges=8
    )
    return averaged.drop("amount")


@plan(
    """SELECT o_orderkey, o_orderdate,
        CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) OVER w AS DOUBLE) / count(*) OVER w
            AS moving_avg
    FROM orders
    WINDOW w AS (ORDER BY o_orderdate
        RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)"""
)
def moving_avg_days(spark, sf_dir):
    payment = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", money("o_totalprice").alias("amount")
    )
    return windows.moving_average_days(payment, "amount", "o_orderdate").drop("amount")


@plan(
    f"""SELECT DISTINCT customer_id, full_name,
        date_diff('day', earliest, latest) AS recency,
        CAST(sum(amount) OVER (PARTITION BY customer_id) AS DOUBLE)
            / count(*) OVER (PARTITION BY customer_id) AS avg_amount
    FROM (SELECT *, max(rental_date) OVER (PARTITION BY customer_id) AS latest,
            min(rental_date) OVER (PARTITION BY customer_id) AS earliest
        FROM ({ACTIVITY_SQL}))"""
)
def customer_recency(spark, sf_dir):
    recency = windows.activity_recency(
        customers(spark, sf_dir), rentals(spark, sf_dir), payments(spark, sf_dir)
    )
    return recency.withColumn("recency", F.col("recency").cast("bigint"))


@plan(
    """SELECT event_id, epoch_us(ts) // 1000 AS ts_millis,
        make_timestamp(epoch_us(ts) // 1000 * 1000) AS ts_from_millis
    FROM events""",
    name="epoch_millis",
)
def epoch_milliseconds(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", epoch_millis("ts").alias("ts_millis"))
    return events.withColumn("ts_from_millis", from_epoch_millis("ts_millis").cast("timestamp_ntz"))


@plan(
    " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_rows,
        (SELECT CAST(count(*) AS INTEGER) FROM (DESCRIBE {t})) AS n_columns"""
        for t in TABLES
    )
)
def table_profile(spark, sf_dir):
    return aggregates.table_profile({name: table(spark, sf_dir, name) for name in TABLES})
