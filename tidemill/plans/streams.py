"""Streaming jobs, run over the given tables until everything is processed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.columns import space_tokens, whitespace_tokens
from tidemill.operators import cdc, generate, records
from tidemill.plans.records import (
    FINAL_SALES_SQL,
    NOW,
    SALES_ROW,
    generated_sql,
    generated_table,
    sales_changes,
)
from tidemill.plans.registry import plan, table, table_path
from tidemill.plans.tables import new_database
from tidemill.shared import new_folder
from tidemill.sources import catalog
from tidemill.streaming import sinks
from tidemill.streaming.progress import listening
from tidemill.streaming.sources import TOPIC_SCHEMA, counted_rows, table_stream, text_lines


# Enough to keep a large cluster busy, and few enough to commit progress often.
FILES_PER_BATCH = 10_000
#: Runs of the generating stream, each of one batch.
GENERATED_RUNS = 4


def document_lines(spark, sf_dir) -> DataFrame:
    """The lines of all documents as a stream, column ``value``."""
    path = table_path(sf_dir, "documents")
    documents = table_stream(spark, path, files_per_batch=FILES_PER_BATCH)
    return documents.select(F.explode(F.split("text", "\n")).alias("value"))


def count_lines(lines: DataFrame) -> DataFrame:
    """Count of every distinct line, taken as its list of words."""
    return lines.select(whitespace_tokens("value").alias("word")).groupBy("word").count()


def count_words(lines: DataFrame) -> DataFrame:
    return lines.select(F.explode(space_tokens("value")).alias("word")).groupBy("word").count()


def kept_by_key(aggregate: DataFrame, keys: list[str]) -> DataFrame:
    """A stream's aggregate kept in a keyed table until the stream is drained, and read from there."""
    spark = aggregate.sparkSession
    base, checkpoint = new_folder(spark, "keyed"), new_folder(spark, "checkpoint")
    name = f"{new_database(spark, 'keyed')}.latest"
    sinks.drain(spark, sinks.keyed_table_writer(aggregate, name, base, checkpoint, keys))
    return sinks.read_latest(spark, name, keys)


@plan(
    r"""SELECT array_to_string(string_split_regex(value, '[ \t\n\f\r\v]'), '|') AS words,
        count(*) AS "count"
    FROM (SELECT unnest(string_split(text, chr(10))) AS value FROM documents)
    GROUP BY words"""
)
def stream_line_count(spark, sf_dir):
    counted = kept_by_key(count_lines(document_lines(spark, sf_dir)), ["word"])
    return counted.select(F.concat_ws("|", "word").alias("words"), "count")


@plan(
    """SELECT word, count(*) AS "count"
    FROM (SELECT unnest(string_split(value, ' ')) AS word
        FROM (SELECT unnest(string_split(text, chr(10))) AS value FROM documents))
    GROUP BY word"""
)
def stream_wordcount(spark, sf_dir):
    return kept_by_key(count_words(document_lines(spark, sf_dir)), ["word"])


@plan("""SELECT event_type, count(*) AS "count" FROM events GROUP BY event_type""")
def stream_count_snapshot(spark, sf_dir):
    """Complete mode: the whole result is written after each batch."""
    base, checkpoint = new_folder(spark, "by-type"), new_folder(spark, "checkpoint")
    events = table_stream(spark, table_path(sf_dir, "events"))
    counts = events.groupBy("event_type").count()
    sinks.drain(spark, sinks.snapshot_writer(counts, base, checkpoint))
    return sinks.read_snapshot(spark, base)


VALUE_COLUMNS = ["event_id", "user_id", "event_type", "value"]


def write_topic(spark, sf_dir) -> str:
    """Events as topic records in the files of a folder."""
    events = table(spark, sf_dir, "events")
    rows = records.to_topic_rows(events.select("*"), ["event_id"], VALUE_COLUMNS)
    path = new_folder(spark, "topic")
    topic = rows.select(
        "key",
        "value",
        F.lit("events").alias("topic"),
        F.lit(0).alias("partition"),
        F.get_json_object("key", "$.event_id").cast("bigint").alias("offset"),
        F.lit("2024-01-01").cast("timestamp").alias("timestamp"),
    )
    topic.write.parquet(path)
    return path


@plan("SELECT event_id, user_id, event_type, value, event_id AS \"offset\" FROM events")
def stream_topic_decode(spark, sf_dir):
    """Topic records decoded and appended to a table until the topic is drained."""
    base, checkpoint = new_folder(spark, "decoded"), new_folder(spark, "checkpoint")
    schema = table(spark, sf_dir, "events").select(*VALUE_COLUMNS).schema
    topic = table_stream(spark, write_topic(spark, sf_dir), TOPIC_SCHEMA)
    decoded = records.from_topic_rows(topic, schema, "offset")
    sinks.drain(spark, sinks.appended_table_writer(decoded, base, checkpoint))
    return sinks.read_appended(spark, base)


@plan("SELECT event_id, user_id, value, event_type FROM events")
def stream_append_partitioned(spark, sf_dir):
    path, checkpoint = new_folder(spark, "events-by-type"), new_folder(spark, "checkpoint")
    events = table_stream(spark, table_path(sf_dir, "events")).select(
        "event_id", "user_id", "value", "event_type"
    )
    sinks.drain(spark, sinks.file_stream_writer(events, checkpoint, path, partitions="event_type"))
    return spark.read.parquet(path)


@plan("SELECT event_id, user_id, event_type, value FROM events")
def stream_foreach_batch(spark, sf_dir):
    """A function per micro-batch that appends to a catalog table."""
    base, checkpoint = new_folder(spark, "event-table"), new_folder(spark, "checkpoint")
    name = f"{new_database(spark, 'streamed')}.events"
    columns = {
        "event_id": "bigint",
        "user_id": "bigint",
        "event_type": "string",
        "value": "double",
        sinks.BATCH: "bigint",
    }
    catalog.create_table(spark, name, columns, partition_by=[sinks.BATCH], location=base)
    events = table_stream(spark, table_path(sf_dir, "events")).select(*VALUE_COLUMNS)
    sinks.drain(spark, sinks.batch_writer(events, checkpoint, sinks.insert_batch(name, base)))
    return spark.table(name).drop(sinks.BATCH)


def change_stream(spark, sf_dir) -> DataFrame:
    path = new_folder(spark, "changes")
    sales_changes(spark, sf_dir).write.parquet(path)
    row = spark.createDataFrame([], SALES_ROW).schema
    return cdc.parse_envelopes(table_stream(spark, path, files_per_batch=FILES_PER_BATCH), row)


def latest_sales(spark, sf_dir) -> DataFrame:
    """The change stream's last event of every sale, from the keyed table it is kept in."""
    return kept_by_key(cdc.latest_changes(change_stream(spark, sf_dir), ["sale_id"]), ["sale_id"])


@plan(
    f"""SELECT 'total_sales' AS key_name, CAST(sum(sale_amount) AS DOUBLE) AS total
    FROM ({FINAL_SALES_SQL})"""
)
def cdc_running_total(spark, sf_dir):
    total = cdc.running_total(latest_sales(spark, sf_dir), "sale_amount", "total_sales")
    return total.withColumn("total", F.col("total").cast("double"))


@plan(
    f"""SELECT sale_id, product_id, CAST(sale_amount AS DOUBLE) AS sale_amount
    FROM ({FINAL_SALES_SQL})"""
)
def cdc_latest_state(spark, sf_dir):
    rows = cdc.current_rows(latest_sales(spark, sf_dir))
    return rows.withColumn("sale_amount", F.col("sale_amount").cast("double"))


ARRIVALS = 4
ARRIVING_SQL = f"""WITH changes AS (
    SELECT o_orderkey AS sale_id, unnest(CASE o_orderstatus WHEN 'F' THEN [1, 3] WHEN 'O' THEN [1, 4]
            ELSE [1, 2] END) AS step, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(10,2)) AS price
    FROM orders),
arriving AS (
    SELECT sale_id, step, (sale_id // 8 + step) % {ARRIVALS} AS arrival,
        CASE WHEN step = 4 THEN 0 WHEN step = 3 THEN price - 1 ELSE price END AS amount
    FROM changes),
held AS (
    SELECT n, sale_id, arg_max(amount, step) AS amount
    FROM arriving, range({ARRIVALS}) t(n) WHERE arrival <= n GROUP BY n, sale_id)
"""


@plan(
    ARRIVING_SQL
    + """SELECT n AS batch_id, 'total_sales' AS key_name, CAST(sum(amount) AS DOUBLE) AS total
    FROM held GROUP BY n"""
)
def cdc_continuous_total(spark, sf_dir):
    """The total after every batch of changes; each batch is a run of its own.

    Changes of a sale arrive in any order, a deletion before the creation too, and those
    of a batch come once more two batches later.
    """
    changes, path = sales_changes(spark, sf_dir), new_folder(spark, "arriving")
    base, checkpoint = new_folder(spark, "totals"), new_folder(spark, "checkpoint")
    lsn = F.get_json_object("value", "$.source.lsn").cast("bigint")
    arrival = F.pmod(F.floor(lsn / 64) + lsn % 8, F.lit(ARRIVALS))
    arriving, logged = changes.where(lsn >= 0), new_folder(spark, "change-log")
    arriving.select("key", "value", arrival.alias("arrival")).write.partitionBy("arrival").parquet(logged)
    arriving = spark.read.parquet(logged)
    schema = changes.schema
    row = spark.createDataFrame([], SALES_ROW).schema
    for batch in range(ARRIVALS):
        part = arriving.where(F.col("arrival").isin(batch, batch - 2)).drop("arrival")
        part.write.mode("append").parquet(path)
        events = table_stream(spark, path, schema, files_per_batch=FILES_PER_BATCH)
        differences = cdc.amount_changes(
            cdc.parse_envelopes(events, row), "sale_id", "sale_amount", group=F.expr("sale_id div 64")
        )
        sinks.drain(spark, sinks.total_writer(differences, base, checkpoint, "change"))
    totals = sinks.read_totals(spark, base)
    return totals.select(
        "batch_id", F.lit("total_sales").alias("key_name"), F.col("total").cast("double").alias("total")
    )


@plan(
    r"""SELECT array_to_string(string_split_regex(value, '[ \t\n\f\r\v]'), '|') AS words,
        count(*) AS "count"
    FROM (SELECT unnest(string_split(text, chr(10))) AS value FROM documents)
    GROUP BY words"""
)
def stream_text_files(spark, sf_dir):
    """Text files that arrive between two runs, counted line by line and then put away."""
    folder, archive = new_folder(spark, "arriving"), new_folder(spark, "archive")
    base, checkpoint = new_folder(spark, "counts"), new_folder(spark, "checkpoint")
    name = f"{new_database(spark, 'lines')}.counts"
    lines = table(spark, sf_dir, "documents").select(
        F.col("doc_id"), F.explode(F.split("text", "\n")).alias("value")
    )
    for turn in range(2):
        arrived = lines.where(F.pmod("doc_id", F.lit(2)) == turn).select("value")
        arrived.write.mode("append").text(folder)
        counts = count_lines(text_lines(spark, folder, FILES_PER_BATCH, archive=archive))
        sinks.drain(spark, sinks.keyed_table_writer(counts, name, base, checkpoint, ["word"]))
    counted = sinks.read_latest(spark, name, ["word"])
    return counted.select(F.concat_ws("|", "word").alias("words"), "count")


@plan("SELECT event_id, user_id, value, event_type FROM events")
def stream_table(spark, sf_dir):
    """Events streamed into a partitioned table by two runs, and read by the table's name."""
    path, base = new_folder(spark, "arriving"), new_folder(spark, "event-table")
    checkpoint, name = new_folder(spark, "checkpoint"), f"{new_database(spark, 'streamed')}.by_type"
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type")
    for turn in range(2):
        events.where(F.pmod("event_id", F.lit(2)) == turn).write.mode("append").parquet(path)
        stream = table_stream(spark, path, events.schema, files_per_batch=FILES_PER_BATCH)
        sinks.drain(spark, sinks.table_writer(stream, name, base, checkpoint, ["event_type"]))
    return spark.table(name).drop(sinks.BATCH)


@plan(f"SELECT serial AS key, * FROM ({generated_sql(one_digest=True)})")
def stream_generated(spark, sf_dir):
    """Generated records of the orders, whose keys a clock of rows counts up in several runs."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    last = orders.agg(F.max("id")).first()[0]
    base, checkpoint = new_folder(spark, "generated"), new_folder(spark, "checkpoint")
    declared, moment = generated_table(), F.lit(NOW).cast("timestamp")
    for _ in range(GENERATED_RUNS):
        ids = counted_rows(spark, last // GENERATED_RUNS + 1).select("id").join(orders, "id", "left_semi")
        rows = generate.generate_for(ids, declared, now=moment, one_digest=True)
        topic = generate.as_records(rows, declared)
        sinks.drain(spark, sinks.appended_table_writer(topic, base, checkpoint))
    return records.from_topic_rows(sinks.read_appended(spark, base), rows.schema, "key")


@plan(
    """SELECT 4 AS batches, count(*) AS input_rows, count(DISTINCT event_type)::BIGINT AS last_output_rows
    FROM events"""
)
def stream_console(spark, sf_dir):
    """Counts by type shown on the console in complete mode, and what the batches read."""
    path, checkpoint = new_folder(spark, "events"), new_folder(spark, "checkpoint")
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    for turn in range(4):
        part = events.where(F.pmod("event_id", F.lit(4)) == turn)
        part.coalesce(1).write.mode("append").parquet(path)
    counts = table_stream(spark, path, files_per_batch=1).groupBy("event_type").count()
    with listening(spark) as heard:
        query = sinks.drain(spark, sinks.console_writer(counts, checkpoint))
        batches = heard.of(spark, query)
    return batches.agg(
        F.count_if(F.col("input_rows") > 0).cast("int").alias("batches"),
        F.sum("input_rows").alias("input_rows"),
        F.max_by("output_rows", "batch_id").alias("last_output_rows"),
    )
