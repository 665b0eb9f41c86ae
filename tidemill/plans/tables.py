"""Sources, sinks and catalog tables, each written from a given table and read back."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import aggregates, quality
from tidemill.plans.registry import TABLES, plan, table, table_path
from tidemill.schema import parse_declared
from tidemill.shared import new_folder
from tidemill.sources import catalog, documents, files

CUSTOMER_DECLARED = {
    "schemaName": "customer",
    "dimensionFieldSpecs": [
        {"name": "c_custkey", "dataType": "LONG"},
        {"name": "c_name", "dataType": "STRING"},
        {"name": "c_nationkey", "dataType": "INT"},
        {"name": "c_mktsegment", "dataType": "STRING"},
    ],
    "metricFieldSpecs": [{"name": "c_acctbal", "dataType": "DOUBLE"}],
    "primaryKeyColumns": ["c_custkey"],
}


def new_database(spark, label: str) -> str:
    """A database of its own for one run, located in the shared folder."""
    name = f"{label}_{uuid.uuid4().hex[:12]}"
    catalog.create_database(spark, name, new_folder(spark, name))
    return name


@plan("SELECT * FROM orders")
def csv_roundtrip(spark, sf_dir):
    """A table dumped to text and bulk-loaded into another table."""
    orders = table(spark, sf_dir, "orders")
    path = new_folder(spark, "dump")
    files.dump_text(orders, path)
    name = f"{new_database(spark, 'loaded')}.orders"
    catalog.create_table(spark, name, dict(orders.dtypes))
    catalog.load_text_into(spark, path, name)
    return spark.table(name)


@plan("SELECT * FROM customer")
def csv_with_header(spark, sf_dir):
    path = new_folder(spark, "customer-csv")
    files.write_csv(table(spark, sf_dir, "customer"), path)
    read = files.read_csv(spark, path, sampling=0.1)
    return read.withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


@plan("SELECT * FROM supplier")
def csv_full_inference(spark, sf_dir):
    """Types found from all rows of the files."""
    path = new_folder(spark, "supplier-csv")
    files.write_csv(table(spark, sf_dir, "supplier"), path)
    read = files.read_csv(spark, path)
    return read.withColumn("s_suppkey", F.col("s_suppkey").cast("bigint"))


@plan(
    """SELECT word, count(*) AS "count"
    FROM (SELECT unnest(string_split(value, ' ')) AS word
        FROM (SELECT unnest(string_split(text, chr(10))) AS value FROM documents))
    GROUP BY word ORDER BY word DESC"""
)
def text_wordcount(spark, sf_dir):
    """The lines of all documents as text files, read as one column and counted."""
    path = new_folder(spark, "lines")
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")))
    lines.write.text(path)
    return aggregates.word_count(files.read_lines(spark, path))


@plan(
    """SELECT c_nationkey, sum(strlen(c_name) + 1)::BIGINT AS n_bytes,
        sha256(string_agg(c_name || chr(10), '' ORDER BY c_custkey)) AS checksum
    FROM customer GROUP BY c_nationkey"""
)
def object_checksums(spark, sf_dir):
    """Names of customers in a file for each nation, the files read as objects."""
    path = new_folder(spark, "names")
    ordered = table(spark, sf_dir, "customer").repartition("c_nationkey")
    ordered = ordered.sortWithinPartitions("c_nationkey", "c_custkey")
    ordered.select("c_name", "c_nationkey").write.partitionBy("c_nationkey").text(path)
    found = files.load_objects(spark, path, "*.txt", recursive=True)
    return found.select(
        F.regexp_extract("path", "c_nationkey=([0-9]+)", 1).cast("bigint").alias("c_nationkey"),
        F.octet_length("content").cast("bigint").alias("n_bytes"),
        F.sha2("content", 256).alias("checksum"),
    )


@plan(
    """SELECT col_name, data_type, (SELECT count(*) FROM customer) AS n_rows, true AS here, true AS listed
    FROM (VALUES ('c_custkey', 'bigint'), ('c_name', 'string'), ('c_nationkey', 'int'),
        ('c_mktsegment', 'string'), ('c_acctbal', 'double')) v(col_name, data_type)"""
)
def table_described(spark, sf_dir):
    """A saved table as the current database and the description of the table see it."""
    database = new_database(spark, "described")
    before = catalog.current_database(spark).first()[0]
    customer = table(spark, sf_dir, "customer")
    catalog.use_database(spark, database)
    try:
        catalog.save_table(customer, "customer")
        here = catalog.current_database(spark).first()[0] == database
        listed = catalog.show_databases(spark).where(F.col("namespace") == database).count() == 1
        described = catalog.describe_table(spark, "customer").select("col_name", "data_type")
        n_rows = spark.table("customer").count()
    finally:
        catalog.use_database(spark, before)
    return described.where(F.col("col_name").isin(customer.columns)).select(
        "col_name", "data_type", F.lit(n_rows).alias("n_rows"),
        F.lit(here).alias("here"), F.lit(listed).alias("listed"),
    )


@plan(
    """SELECT 'path' AS place, * FROM customer UNION ALL SELECT 'table' AS place, * FROM customer"""
)
def table_readback(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    path = new_folder(spark, "saved")
    files.save_table_path(customer, path)
    name = f"{new_database(spark, 'readback')}.customer"
    catalog.save_table(customer, name)
    read = files.read_table_path(spark, path).select(F.lit("path").alias("place"), "*")
    return read.unionByName(spark.table(name).select(F.lit("table").alias("place"), "*"))


ORDER_COLUMNS = {
    "o_orderkey": "bigint",
    "o_custkey": "bigint",
    "o_orderstatus": "string",
    "o_totalprice": "double",
    "order_year": "int",
}


@plan(
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
        CAST(year(o_orderdate) AS INTEGER) AS order_year
    FROM orders"""
)
def partitioned_append(spark, sf_dir):
    """Two appends into the folder of an external table with yearly partitions."""
    orders = table(spark, sf_dir, "orders").withColumn("order_year", F.year("o_orderdate"))
    orders = orders.select(*ORDER_COLUMNS)
    location = new_folder(spark, "orders-by-year")
    name = f"{new_database(spark, 'append')}.orders_by_year"
    catalog.create_table(
        spark, name, ORDER_COLUMNS, partition_by=["order_year"], location=location
    )
    finished = F.col("o_orderstatus") == "F"
    for part in (orders.where(finished), orders.where(~finished)):
        catalog.append_partitioned(part, location, ["order_year"])
        catalog.add_partitions(part, name, ["order_year"])
    return spark.table(name)


@plan("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def insert_into_by_name(spark, sf_dir):
    name = f"{new_database(spark, 'inserts')}.customer"
    columns = {"c_custkey": "bigint", "c_name": "string", "c_mktsegment": "string"}
    catalog.create_table(spark, name, columns)
    shuffled = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_name")
    catalog.insert_by_name(shuffled, name)
    return spark.table(name)


@plan("SELECT * FROM customer")
def append_or_create(spark, sf_dir):
    """The first half of the customers creates the table, the others are appended."""
    customer = table(spark, sf_dir, "customer")
    name = f"{new_database(spark, 'loads')}.customer"
    owing = F.col("c_acctbal") < 0
    for part in (customer.where(owing), customer.where(~owing)):
        catalog.append_or_create(part, name, ["c_custkey"])
    return spark.table(name)


@plan(
    """SELECT 'before' AS moment, count(*) AS n_rows, true AS table_exists FROM customer
    UNION ALL SELECT 'truncated', 0, true UNION ALL SELECT 'dropped', 0, false"""
)
def table_truncate(spark, sf_dir):
    name = f"{new_database(spark, 'truncate')}.customer"
    catalog.save_table(table(spark, sf_dir, "customer"), name)
    steps = [("before", spark.table(name).count(), spark.catalog.tableExists(name))]
    catalog.truncate_table(spark, name)
    spark.catalog.refreshTable(name)
    steps.append(("truncated", spark.table(name).count(), spark.catalog.tableExists(name)))
    catalog.drop_table(spark, name)
    steps.append(("dropped", 0, spark.catalog.tableExists(name)))
    return spark.createDataFrame(steps, "moment string, n_rows bigint, table_exists boolean")


@plan(
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_rows" for t in TABLES
    )
)
def catalog_tables(spark, sf_dir):
    """Register every given table in a new database, and count each by name."""
    database = new_database(spark, "given")
    for name in TABLES:
        catalog.run_statement(
            spark,
            f"CREATE TABLE {database}.{name} USING parquet LOCATION '{table_path(sf_dir, name)}'",
        )
    listed = catalog.show_tables(spark, database).where("NOT isTemporary")
    names = [row["tableName"] for row in listed.collect()]
    counts = [
        catalog.run_statement(
            spark, f"SELECT '{name}' AS table_name, count(*) AS n_rows FROM {database}.{name}"
        )
        for name in names
    ]
    return functools.reduce(DataFrame.unionByName, counts)


@plan(
    """SELECT n_name, count(*) AS n_customers,
        CAST(sum(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE) AS balance
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"""
)
def cross_database_join(spark, sf_dir):
    people, places = new_database(spark, "people"), new_database(spark, "places")
    catalog.save_table(table(spark, sf_dir, "customer"), f"{people}.customer")
    catalog.save_table(table(spark, sf_dir, "nation"), f"{places}.nation")
    return catalog.run_statement(
        spark,
        f"""SELECT n_name, sum(n) AS n_customers, CAST(sum(balance) AS DOUBLE) AS balance
        FROM (SELECT c_nationkey, count(*) AS n, sum(CAST(c_acctbal AS DECIMAL(12,2))) AS balance
            FROM {people}.customer GROUP BY c_nationkey)
        JOIN {places}.nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    )


@plan("SELECT c_custkey, c_name, c_nationkey, c_mktsegment, c_acctbal FROM customer")
def ingest_declared(spark, sf_dir):
    """CSV files in nested folders, in another column order than declared."""
    customer = table(spark, sf_dir, "customer").select(
        "c_mktsegment", "c_acctbal", "c_nationkey", "c_name", "c_custkey"
    )
    folder = new_folder(spark, "incoming")
    owing = F.col("c_acctbal") < 0
    files.write_csv(customer.where(owing), f"{folder}/owing/a")
    files.write_csv(customer.where(~owing), f"{folder}/paid")
    ingested = files.ingest_declared(spark, folder, parse_declared(CUSTOMER_DECLARED))
    name = f"{new_database(spark, 'ingest')}.customer"
    catalog.append_or_create(ingested, name, ["c_custkey"])
    return spark.table(name)


@plan(" UNION ALL ".join(f"SELECT '{t}.parquet' AS file_name" for t in TABLES))
def file_listing(spark, sf_dir):
    listed = files.list_objects(spark, sf_dir, "*.parquet").where(F.col("length") > 0)
    return listed.select(F.element_at(F.split("path", "/"), -1).alias("file_name"))


@plan(
    """SELECT 'customers' AS "check", CAST(count(*) AS VARCHAR) AS actual,
        CAST(count(*) AS VARCHAR) AS expected, true AS ok FROM customer
    UNION ALL SELECT 'orders without customer', '0', '0', true
    UNION ALL SELECT 'table customer', 'true', 'true', true
    UNION ALL SELECT 'table missing', 'false', 'true', false"""
)
def check_results(spark, sf_dir):
    database = new_database(spark, "checks")
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    catalog.save_table(customer, f"{database}.customer")
    stored = spark.table(f"{database}.customer")
    orphans = orders.join(customer, orders["o_custkey"] == customer["c_custkey"], "left_anti")
    results = quality.check_results(
        {
            "customers": (stored.agg(F.count(F.lit(1)).alias("n")), customer.count()),
            "orders without customer": (orphans.agg(F.count(F.lit(1)).alias("n")), 0),
        }
    )
    tables = quality.check_tables(spark, [f"{database}.customer", f"{database}.missing"])
    return results.unionByName(
        tables.withColumn("check", F.regexp_replace("check", f"{database}\\.", ""))
    )


@plan(
    """WITH people AS (
        SELECT c_custkey, CASE WHEN c_nationkey <> 5 THEN c_name END AS c_name,
            CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer)
    SELECT 0 AS position, 'c_custkey' AS "column", 'bigint' AS type, count(*) AS n_rows,
        count(*) - count(c_custkey) AS n_nulls FROM people
    UNION ALL SELECT 1, 'c_name', 'string', count(*), count(*) - count(c_name) FROM people
    UNION ALL SELECT 2, 'c_acctbal', 'double', count(*), count(*) - count(c_acctbal) FROM people
    UNION ALL SELECT 3, 'c_mktsegment', 'string', count(*), count(*) - count(c_mktsegment) FROM people"""
)
def table_columns_profile(spark, sf_dir):
    """Columns of a table, their types, rows and nulls, counted while it is saved."""
    people = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_nationkey") != 5, F.col("c_name")).alias("c_name"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"), "c_mktsegment",
    )
    return catalog.save_profiled(people, f"{new_database(spark, 'profiled')}.people")


def mixed_documents(spark, sf_dir) -> DataFrame:
    """Events as documents whose fields and types differ by kind."""
    events = table(spark, sf_dir, "events")
    kind, value = F.col("event_type"), F.col("value")
    return documents.as_documents(
        events.select(
            F.col("event_id").alias("_id"), F.col("event_type").alias("kind"),
            # a number, a text, or nothing
            F.when(kind == "purchase", F.to_json(F.struct(value.alias("amount")))).alias("price"),
            F.when(kind == "click", F.array(F.lit("a"), F.col("user_id").cast("string"))).alias("tags"),
            F.when(kind != "click", F.struct(F.col("user_id"), F.col("ts").cast("string").alias("at"))).alias("user"),
        )
    )


@plan(
    """SELECT event_id AS id, event_type AS kind, CASE WHEN event_type = 'click' THEN 2 END AS n_tags,
        CASE WHEN event_type <> 'click' THEN user_id END AS user_id,
        CASE WHEN event_type = 'click' THEN user_id::VARCHAR END AS second_tag,
        CASE WHEN event_type = 'purchase' THEN value END AS amount, true AS id_gone
    FROM events"""
)
def json_docs_mixed(spark, sf_dir):
    """Documents of differing shape written, read without a schema, changed, written and read again."""
    first, second = new_folder(spark, "documents"), new_folder(spark, "documents")
    documents.write_documents(mixed_documents(spark, sf_dir), first)
    read = documents.with_fields(documents.read_documents(spark, first), {"id": ("$._id", "bigint")})
    bare = documents.without_fields(read, "_id")
    bare.write.parquet(second)
    again = documents.with_fields(
        spark.read.parquet(second),
        {
            "kind": ("$.kind", "string"), "tags": ("$.tags", "array<string>"),
            "user_id": ("$.user.user_id", "bigint"), "second_tag": ("$.tags[1]", "string"),
            "price": ("$.price", "string"), "gone": ("$._id", "bigint"),
        },
    )
    return again.select(
        "id", "kind", F.when(F.col("tags").isNotNull(), F.size("tags")).alias("n_tags"), "user_id",
        "second_tag", F.get_json_object("price", "$.amount").cast("double").alias("amount"),
        F.col("gone").isNull().alias("id_gone"),
    )


@plan(
    """SELECT event_id AS _id, event_type AS kind,
        CASE WHEN event_type <> 'click' THEN user_id END AS user_id FROM events"""
)
def json_docs_typed(spark, sf_dir):
    """The rows of documents without a declared schema, by the types found in them."""
    path = new_folder(spark, "documents")
    documents.write_documents(mixed_documents(spark, sf_dir), path)
    rows = documents.typed_rows(documents.read_documents(spark, path))
    return rows.select(F.col("_id").cast("bigint").alias("_id"), "kind", F.col("user.user_id").cast("bigint").alias("user_id"))
