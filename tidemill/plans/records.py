"""JSON records, caption cleaning, change events and generated rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import cdc, generate, records
from tidemill.plans.registry import plan, table
from tidemill.schema import parse_declared
from tidemill.shared import new_folder
from tidemill.sources import files

CAPTIONS_SCHEMA = "_id bigint, caption string, created_time string"
NOW = "2024-06-01 12:00:00"


@plan(
    """SELECT caption, len(string_split(caption, ' ')) :: INTEGER AS caption_size,
        CASE WHEN lang <> 'de' THEN make_timestamp((1704067200 + doc_id) * 1000000) END AS created_time
    FROM (SELECT *, CASE WHEN n_chars >= 100 THEN text END AS caption FROM documents)
    WHERE len(string_split(caption, ' ')) < 50"""
)
def json_docs_clean(spark, sf_dir):
    """Documents as JSON with a text time, unreadable for one language, and null
    captions in place of the shortest texts."""
    documents = table(spark, sf_dir, "documents")
    moment = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id"))
    raw = documents.select(
        F.col("doc_id").alias("_id"),
        F.when(F.col("n_chars") >= 100, F.col("text")).alias("caption"),
        F.when(F.col("lang") != "de", F.date_format(moment, "yyyy-MM-dd HH:mm:ss"))
        .otherwise("yesterday")
        .alias("created_time"),
    )
    path = new_folder(spark, "captions")
    raw.write.json(path)
    cleaned = records.clean_captions(files.read_json(spark, path, CAPTIONS_SCHEMA))
    return cleaned.withColumn("created_time", F.col("created_time").cast("timestamp_ntz"))


TRIP_SOURCE = {
    "vendorId": "l_suppkey",
    "passenger_count": "l_linenumber",
    "trip_distance": "l_quantity",
    "pickup_location": "l_partkey",
    "dropoff_location": "l_orderkey",
    "payment_type": "l_linenumber",
    "total_amount": "l_extendedprice",
}


@plan(
    """SELECT CAST(l_suppkey AS INTEGER) AS "vendorId", l_linenumber AS passenger_count,
        l_quantity AS trip_distance, CAST(l_partkey AS INTEGER) AS pickup_location,
        CAST(l_orderkey AS INTEGER) AS dropoff_location, l_linenumber AS payment_type,
        l_extendedprice AS total_amount, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS pickup_datetime,
        CAST(l_suppkey AS INTEGER) AS record_key
    FROM lineitem"""
)
def ride_records(spark, sf_dir):
    """Trips as keyed JSON records, and the records read again."""
    trips = table(spark, sf_dir, "lineitem").select(
        *[F.col(c).cast("string") for c in sorted(set(TRIP_SOURCE.values()))], "l_shipdate"
    )
    rides = records.ride_rows(trips, F.col("l_shipdate"), TRIP_SOURCE)
    topic = records.to_topic_rows(rides, ["vendorId"], rides.columns)
    decoded = records.from_topic_rows(topic, records.RIDE_SCHEMA, "key")
    return decoded.withColumn(
        "record_key", F.get_json_object("key", "$.vendorId").cast("int")
    ).drop("key")


EVENT_SCHEMA = "event_id bigint, user_id bigint, event_type string, value double"


@plan("SELECT event_id, user_id, event_type, value FROM events")
def json_values_to_rows(spark, sf_dir):
    """Message values appended to a CSV without header, in a fixed column order."""
    names = ["event_id", "user_id", "event_type", "value"]
    events = table(spark, sf_dir, "events")
    topic = records.to_topic_rows(events, ["event_id"], names)
    rows = records.from_topic_rows(topic, events.select(*names).schema)
    path = new_folder(spark, "messages")
    cheap = F.col("value") < 50
    for part in (rows.where(cheap), rows.where(~cheap)):
        files.write_csv(part, path, header=False, mode="append")
    return files.read_csv(spark, path, EVENT_SCHEMA, header=False)


SALES_ROW = "sale_id bigint, product_id bigint, sale_amount decimal(10,2)"


def sales_changes(spark, sf_dir):
    """Change events of a sales table, one topic row per event.

    Every order is created, those of status P as a snapshot read, which a second
    snapshot repeats. Orders of status F are later reduced by 1.00 by an update that
    comes twice, every other one without its row before. Those of status O are deleted,
    with the key alone before, which also writes a tombstone. A row that was there
    before the table was emptied is written first.
    """
    amount = F.col("o_totalprice").cast("decimal(10,2)")

    def image(value, product=F.col("o_custkey")):
        return F.struct(
            F.col("o_orderkey").alias("sale_id"),
            product.cast("bigint").alias("product_id"),
            value.cast("decimal(10,2)").alias("sale_amount"),
        )

    nothing = F.lit(None).cast(f"struct<{SALES_ROW.replace(' ', ':').replace(',:', ', ')}>")
    position = F.col("o_orderkey") * 8

    def event(op, before, after, step):
        place = F.struct(
            (position + step).alias("lsn"), F.lit(1700000000000).alias("ts_ms"),
            F.lit("false").alias("snapshot"),
        )
        return F.to_json(
            F.struct(
                op.alias("op"), before.alias("before"), after.alias("after"),
                place.alias("source"), F.lit(1700000000001).alias("ts_ms"),
            )
        )

    status = F.col("o_orderstatus")
    created = event(F.when(status == "P", "r").otherwise("c"), nothing, image(amount), 1)
    again = event(F.lit("r"), nothing, image(amount), 2)
    before = F.when(F.col("o_orderkey") % 2 == 0, image(amount)).otherwise(nothing)
    updated = event(F.lit("u"), before, image(amount - 1), 3)
    deleted = event(F.lit("d"), image(F.lit(None), F.lit(None)), nothing, 4)
    tombstone = F.lit(None).cast("string")
    values = (
        F.when(status == "F", F.array(created, updated, updated))
        .when(status == "O", F.array(created, deleted, tombstone))
        .otherwise(F.array(created, again))
    )
    orders = table(spark, sf_dir, "orders")
    key = F.to_json(F.struct(F.col("o_orderkey").alias("sale_id"))).alias("key")
    place = F.struct(F.lit(-1).cast("bigint").alias("lsn"), F.lit(1).cast("bigint").alias("ts_ms"))
    emptied = F.to_json(F.struct(F.lit("t").alias("op"), place.alias("source")))
    earlier = F.to_json(
        F.struct(
            F.lit("c").alias("op"),
            F.struct((-F.col("n") - 1).alias("sale_id"), F.lit(9).alias("sale_amount")).alias("after"),
            F.struct((-F.col("n") - 2).alias("lsn")).alias("source"),
        )
    )
    old = orders.agg(F.count("*").alias("n")).select(
        F.lit(None).cast("string").alias("key"), F.explode(F.array(earlier, emptied)).alias("value")
    )
    return orders.select(key, F.explode(values).alias("value")).union(old)


FINAL_SALES_SQL = """SELECT o_orderkey AS sale_id, o_custkey AS product_id,
        CAST(o_totalprice AS DECIMAL(10,2)) - CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END
            AS sale_amount
    FROM orders WHERE o_orderstatus <> 'O'"""


def generated_table():
    return parse_declared(
        {
            "schemaName": "devices",
            "dimensionFieldSpecs": [
                {"name": "reading", "dataType": "INT"},
                {"name": "serial", "dataType": "STRING"},
                {"name": "device_type", "dataType": "STRING"},
                {"name": "browser_version", "dataType": "STRING"},
                {"name": "company", "dataType": "STRING"},
                {"name": "phone", "dataType": "STRING"},
                {"name": "description", "dataType": "STRING"},
                {"name": "day", "dataType": "DATE"},
                {"name": "clock", "dataType": "TIME"},
                {"name": "payload", "dataType": "JSON"},
            ],
            "metricFieldSpecs": [{"name": "score", "dataType": "DOUBLE"}],
            "primaryKeyColumns": ["serial"],
            "dateTimeFieldSpecs": [
                {"name": "ts", "dataType": "LONG", "format": "1:MILLISECONDS:EPOCH"}
            ],
        }
    )


def generated(spark, sf_dir):
    """One generated row per order, made from the order's key."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return generate.generate_for(orders, generated_table(), now=F.lit(NOW).cast("timestamp"))


def generated_sql(one_digest: bool = False) -> str:
    """What ``generate_for`` gives for the orders."""

    def hashed(column: str, part: int = 0, digits: int = 15) -> str:
        if one_digest:
            return f"('0x' || substr(md5(o_orderkey || '|{column}|0'), {digits * part + 1}, {digits}))::BIGINT"
        return f"('0x' || substr(md5(o_orderkey || '|{column}|0|{part}'), 1, 15))::BIGINT"

    def chosen(words, column: str, part: int = 0, digits: int = 15) -> str:
        listed = ", ".join(f"'{w}'" for w in words)
        return f"([{listed}])[{hashed(column, part, digits)} % {len(words)} + 1]"

    def phrase(column: str, nth: int) -> list[str]:
        kinds = (generate.VERBS, generate.QUALITIES, generate.NOUNS)
        return [chosen(w, column, i, 3) for i, w in enumerate(kinds, 3 * nth)]

    def sentences(column: str) -> str:
        def capital(part: str) -> str:
            return f"upper({part}[1]) || substr({part}, 2)"

        three = [" || ' ' || ".join(map(capital, phrase(column, n))) for n in range(3)]
        return " || '. ' || ".join(three) + " || '.'"

    def digits(column: str, part: int, count: int) -> str:
        return f"lpad(({hashed(column, part, 8)} % {10**count})::VARCHAR, {count}, '0')"

    code = " || ".join(
        f"substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
        f"({hashed('serial')} % {generate.CODES} // {36**i} % 36)::INTEGER + 1, 1)"
        for i in reversed(range(generate.CODE_LENGTH))
    )
    unit = f"({hashed('score')} % {generate.FRACTIONS})::DOUBLE / {float(generate.FRACTIONS)}::DOUBLE"
    spread = generate.DOUBLE_HIGH - generate.DOUBLE_LOW
    return f"""SELECT ({hashed("reading")} % {generate.DEFAULT_ROWS + 1})::INTEGER AS reading,
        {code} AS serial,
        {chosen(generate.VOCABULARIES["device_types"], "device_type")} AS device_type,
        {chosen(generate.VOCABULARIES["browser_versions"], "browser_version")} AS browser_version,
        {" || ' ' || ".join(phrase("company", 0))} AS company,
        {digits("phone", 0, 3)} || '-' || {digits("phone", 1, 3)} || '-'
            || {digits("phone", 2, 4)} AS phone,
        {sentences("description")} AS description,
        DATE '2024-06-01' AS day, '12:00:00.000000' AS clock, 'unknown' AS payload,
        {generate.DOUBLE_LOW}::DOUBLE + {unit} * {spread!r}::DOUBLE AS score,
        1717243200000 AS ts
    FROM orders"""


GENERATED_SQL = generated_sql()


@plan(GENERATED_SQL)
def generate_table(spark, sf_dir):
    return generated(spark, sf_dir)


@plan(f"SELECT serial AS key, * FROM ({GENERATED_SQL})")
def generate_records(spark, sf_dir):
    """Generated rows as keyed records, and the records read again."""
    rows = generated(spark, sf_dir)
    topic = generate.as_records(rows, generated_table())
    return records.from_topic_rows(topic, rows.schema, "key")


PROFILE_SQL = """SELECT count(*) AS n_rows, true AS readings_in_range, true AS scores_in_range,
        true AS serials_well_formed, true AS device_types_known, true AS browser_versions_known,
        true AS phones_well_formed, 1717243200000 AS ts
    FROM orders"""


def profile(rows):
    """What has to hold for the generated rows, whatever the hash gives."""
    words = generate.VOCABULARIES
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.bool_and(F.col("reading").between(0, generate.DEFAULT_ROWS)).alias("readings_in_range"),
        F.bool_and(F.col("score").between(0.01, 99.99)).alias("scores_in_range"),
        F.bool_and(F.col("serial").rlike("^[A-Z0-9]{10}$")).alias("serials_well_formed"),
        F.bool_and(F.col("device_type").isin(*words["device_types"])).alias("device_types_known"),
        F.bool_and(F.col("browser_version").isin(*words["browser_versions"])).alias(
            "browser_versions_known"
        ),
        F.bool_and(F.col("phone").rlike("^[0-9]{3}-[0-9]{3}-[0-9]{4}$")).alias("phones_well_formed"),
        F.max("ts").alias("ts"),
    )


@plan(PROFILE_SQL)
def generate_profile(spark, sf_dir):
    return profile(generated(spark, sf_dir))


@plan(PROFILE_SQL)
def generate_ingest(spark, sf_dir):
    """Generated rows written as the input of a batch job, and ingested from there."""
    job = {
        "inputDirURI": new_folder(spark, "generated"),
        "recordReaderSpec": {"dataFormat": "csv"},
    }
    folder = generate.write_batch_input(generated(spark, sf_dir), job)
    return profile(files.ingest_declared(spark, folder, generated_table()))


@plan(
    f"""SELECT 'total_sales' AS key_name, CAST(sum(sale_amount) AS DOUBLE) AS total
    FROM ({FINAL_SALES_SQL})"""
)
def cdc_total_batch(spark, sf_dir):
    """The running total's recipe over the whole change log at once."""
    row = spark.createDataFrame([], SALES_ROW).schema
    changes = cdc.parse_envelopes(sales_changes(spark, sf_dir), row)
    latest = cdc.latest_changes(changes, ["sale_id"])
    total = cdc.running_total(latest, "sale_amount", "total_sales")
    return total.withColumn("total", F.col("total").cast("double"))
