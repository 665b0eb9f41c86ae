"""Dimension loads, keyed writes and load audit.

The dimension and the stage are both made of all rows of ``customer``: some keys are
only in one of them, some attributes differ or are null. Loads that write are applied to
a stored keyed table, which is read again.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import audit as audits
from tidemill.operators import relational, warehouse
from tidemill.operators.skew import hot_keys
from tidemill.plans.registry import plan, table
from tidemill.plans.tables import new_database
from tidemill.sources import keyed

NOW = "2024-06-01 12:00:00"
COLUMNS = ["code", "name", "segment", "balance"]
SPECIAL = ["code"]
#: Codes from here on are staged only; negative ones are in the dimension only.
NEW_CODES = 1_000_000_000
#: Partitions of a stored dimension.
PARTS = 8


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def dimension(spark, sf_dir):
    nation = F.col("c_nationkey")
    return (
        table(spark, sf_dir, "customer")
        .select(
            F.when(F.col("c_mktsegment") == "MACHINERY", -F.col("c_custkey"))
            .otherwise(F.col("c_custkey"))
            .alias("code"),
            F.when(nation != 5, F.col("c_name")).alias("name"),
            F.when(~nation.isin(5, 6), F.col("c_mktsegment")).alias("segment"),
            F.when(nation != 5, F.col("c_acctbal")).alias("balance"),
        )
    )


def staged(spark, sf_dir):
    return (
        table(spark, sf_dir, "customer")
        .select(
            F.when(F.col("c_mktsegment") == "FURNITURE", F.col("c_custkey") + NEW_CODES)
            .otherwise(F.col("c_custkey"))
            .alias("code"),
            F.col("c_name").alias("name"),
            F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment"),
            F.when(F.col("c_nationkey") < 5, F.col("c_acctbal") + 1)
            .otherwise(F.col("c_acctbal"))
            .alias("balance"),
        )
    )


DIM_STAGE_SQL = f"""WITH dim AS (
    SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN -c_custkey ELSE c_custkey END AS code,
        CASE WHEN c_nationkey <> 5 THEN c_name END AS name,
        CASE WHEN c_nationkey NOT IN (5, 6) THEN c_mktsegment END AS segment,
        CASE WHEN c_nationkey <> 5 THEN c_acctbal END AS balance
    FROM customer),
stage AS (
    SELECT CASE WHEN c_mktsegment = 'FURNITURE' THEN c_custkey + {NEW_CODES} ELSE c_custkey END AS code,
        c_name AS name,
        CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment,
        CASE WHEN c_nationkey < 5 THEN c_acctbal + 1 ELSE c_acctbal END AS balance
    FROM customer),
joined AS (
    SELECT s.code, d.name, d.segment, d.balance,
        s.name AS name_new, s.segment AS segment_new, s.balance AS balance_new
    FROM dim d RIGHT JOIN stage s ON d.code = s.code),
fresh AS (
    SELECT code, name_new AS name, segment_new AS segment, balance_new AS balance
    FROM joined WHERE name IS NULL AND segment IS NULL AND balance IS NULL),
changed AS (
    SELECT code, name_new AS name, segment_new AS segment, balance_new AS balance
    FROM joined
    WHERE (name IS NULL AND name_new IS NOT NULL) OR name <> name_new
        OR (segment IS NULL AND segment_new IS NOT NULL) OR segment <> segment_new
        OR (balance IS NULL AND balance_new IS NOT NULL) OR balance <> balance_new)
"""


@plan(DIM_STAGE_SQL + "SELECT * FROM joined")
def join_right_suffix(spark, sf_dir):
    stage = staged(spark, sf_dir)
    return relational.join_right_suffix(
        dimension(spark, sf_dir), stage, ["code"], hot=hot_keys(stage, ["code"])
    )


@plan(DIM_STAGE_SQL + "SELECT * FROM stage WHERE code NOT IN (SELECT code FROM dim)")
def join_anti(spark, sf_dir):
    return relational.without_match(staged(spark, sf_dir), dimension(spark, sf_dir), ["code"])


@plan(DIM_STAGE_SQL + "SELECT * FROM fresh")
def scd1_new(spark, sf_dir):
    joined = relational.join_right_suffix(dimension(spark, sf_dir), staged(spark, sf_dir), ["code"])
    return warehouse.scd1_new_rows(joined, COLUMNS, SPECIAL)


@plan(DIM_STAGE_SQL + "SELECT * FROM changed")
def scd1_updated(spark, sf_dir):
    joined = relational.join_right_suffix(dimension(spark, sf_dir), staged(spark, sf_dir), ["code"])
    return warehouse.scd1_updated_rows(joined, COLUMNS, SPECIAL)


@plan(
    DIM_STAGE_SQL
    + """SELECT 'inserted' AS change, * FROM fresh
    UNION ALL
    SELECT 'updated' AS change, * FROM changed WHERE code NOT IN (SELECT code FROM fresh)"""
)
def scd1_find(spark, sf_dir):
    return warehouse.scd1_changes(dimension(spark, sf_dir), staged(spark, sf_dir), SPECIAL)


def stored(spark, df, keys=("code",), *, unique=True) -> str:
    """``df`` as a keyed table of a database of its own."""
    name = f"{new_database(spark, 'dimension')}.rows"
    keyed.create_keyed(df, name, keys, keyed.hashed_part(keys, PARTS), unique=unique)
    return name


LOADED_SQL = f"""TIMESTAMP '{NOW}' AS "modifiedDate" """


@plan(
    DIM_STAGE_SQL
    + f"""SELECT *, {LOADED_SQL} FROM stage
    UNION ALL
    SELECT *, TIMESTAMP '2024-01-01' FROM dim WHERE code NOT IN (SELECT code FROM stage)"""
)
def scd1_upsert(spark, sf_dir):
    first_load = F.lit("2024-01-01").cast("timestamp_ntz")
    name = stored(spark, warehouse.with_load_time(dimension(spark, sf_dir), first_load))
    keyed.upsert_keyed(spark, name, warehouse.with_load_time(staged(spark, sf_dir), now()))
    return spark.table(name)


INSERTED_SQL = """SELECT * FROM dim
    UNION ALL SELECT * FROM stage WHERE code NOT IN (SELECT code FROM dim)"""


@plan(DIM_STAGE_SQL + INSERTED_SQL)
def insert_if_absent(spark, sf_dir):
    name = stored(spark, dimension(spark, sf_dir))
    keyed.insert_absent_keyed(spark, name, staged(spark, sf_dir))
    return spark.table(name)


@plan(
    DIM_STAGE_SQL
    + f"""SELECT 'stage' AS mode, * FROM ({INSERTED_SQL})
    UNION ALL
    SELECT 'scd-type1', * FROM stage
    UNION ALL
    SELECT 'scd-type1', * FROM dim WHERE code NOT IN (SELECT code FROM stage)"""
)
def load_by_mode(spark, sf_dir):
    loads = []
    for mode in (warehouse.STAGE_MODE, warehouse.SCD1_MODE):
        name = stored(spark, dimension(spark, sf_dir))
        keyed.load_keyed_by_mode(spark, mode, name, staged(spark, sf_dir))
        loads.append(spark.table(name).select(F.lit(mode).alias("mode"), *COLUMNS))
    return loads[0].unionByName(loads[1])


@plan(
    DIM_STAGE_SQL
    + """SELECT d.code, d.name, CASE WHEN s.code IS NULL THEN d.segment ELSE s.segment END AS segment,
        CASE WHEN s.code IS NULL THEN d.balance ELSE s.balance END AS balance
    FROM dim d LEFT JOIN stage s ON d.code = s.code"""
)
def keyed_update(spark, sf_dir):
    name = stored(spark, dimension(spark, sf_dir))
    keyed.update_keyed(spark, name, staged(spark, sf_dir), ["segment", "balance"])
    return spark.table(name)


@plan(
    DIM_STAGE_SQL
    + """SELECT d.code, d.name, CASE WHEN s.code IS NULL THEN d.segment ELSE s.segment END AS segment,
        d.balance
    FROM dim d LEFT JOIN stage s ON d.code = s.code"""
)
def keyed_update_spread(spark, sf_dir):
    """The update of a table whose keys may repeat: hot keys are spread over tasks."""
    return warehouse.keyed_update(
        dimension(spark, sf_dir), staged(spark, sf_dir), ["code"], ["segment"]
    )


@plan(DIM_STAGE_SQL + "SELECT * FROM dim WHERE code NOT IN (SELECT code FROM stage)")
def keyed_delete(spark, sf_dir):
    name = stored(spark, dimension(spark, sf_dir))
    keyed.delete_keyed(spark, name, staged(spark, sf_dir).select("code"))
    return spark.table(name)


def history(spark, sf_dir):
    """Two versions of each customer: an ended one and one that may be current."""
    people = table(spark, sf_dir, "customer")
    uuid = F.concat(F.lit("u-"), F.col("c_custkey").cast("string")).alias("uuid")
    end = F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")
    ended = people.select(
        (F.col("c_custkey") * 2).alias("id"),
        uuid,
        F.lit("OLD").alias("segment"),
        F.lit(False).alias("rowIsCurrent"),
        end.alias("rowEndDate"),
    )
    latest = people.select(
        (F.col("c_custkey") * 2 + 1).alias("id"),
        uuid,
        F.col("c_mktsegment").alias("segment"),
        (F.col("c_acctbal") >= 0).alias("rowIsCurrent"),
        F.when(F.col("c_acctbal") < 0, end).alias("rowEndDate"),
    )
    return ended.unionByName(latest)


def staged_versions(spark, sf_dir):
    """A version for each customer, some in another segment and some of other customers."""
    return (
        table(spark, sf_dir, "customer")
        .select(
            F.concat(
                F.when(F.col("c_mktsegment") == "FURNITURE", "n-").otherwise("u-"),
                F.col("c_custkey").cast("string"),
            ).alias("uuid"),
            F.when(F.col("c_nationkey") < 5, F.lit("MOVED"))
            .otherwise(F.col("c_mktsegment"))
            .alias("segment"),
        )
    )


HISTORY_SQL = f"""WITH history AS (
    SELECT c_custkey * 2 AS id, 'u-' || CAST(c_custkey AS VARCHAR) AS uuid, 'OLD' AS segment,
        false AS current, TIMESTAMP '2023-01-01' AS ended FROM customer
    UNION ALL
    SELECT c_custkey * 2 + 1, 'u-' || CAST(c_custkey AS VARCHAR), c_mktsegment, c_acctbal >= 0,
        CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2023-01-01' END FROM customer),
stage AS (
    SELECT CASE WHEN c_mktsegment = 'FURNITURE' THEN 'n-' ELSE 'u-' END
            || CAST(c_custkey AS VARCHAR) AS uuid,
        CASE WHEN c_nationkey < 5 THEN 'MOVED' ELSE c_mktsegment END AS segment
    FROM customer),
replaced AS (
    SELECT h.uuid FROM history h JOIN stage s ON h.uuid = s.uuid
    WHERE h.current AND h.segment <> s.segment),
after_load AS (
    SELECT id, uuid, segment, current AND uuid NOT IN (SELECT uuid FROM replaced) AS current,
        CASE WHEN current AND uuid IN (SELECT uuid FROM replaced)
            THEN TIMESTAMP '{NOW}' ELSE ended END AS ended
    FROM history)
"""


@plan(
    HISTORY_SQL
    + f"""SELECT id, false AS "rowIsCurrent", TIMESTAMP '{NOW}' AS "rowEndDate"
    FROM history WHERE current AND uuid IN (SELECT uuid FROM stage)"""
)
def scd2_close(spark, sf_dir):
    """The rows that a load ended, as the stored dimension has them afterwards."""
    name = stored(spark, history(spark, sf_dir), ["uuid"], unique=False)
    keyed.load_history(spark, name, staged_versions(spark, sf_dir), now())
    return spark.table(name).where(F.col("rowEndDate") == now()).select(*warehouse.HISTORY_COLUMNS)


@plan(
    HISTORY_SQL
    + f"""SELECT id, false AS "rowIsCurrent", TIMESTAMP '{NOW}' AS "rowEndDate"
    FROM history WHERE uuid IN (SELECT uuid FROM replaced) AND current"""
)
def scd2_changed(spark, sf_dir):
    """The current rows that a load would end, for a table that is kept elsewhere."""
    return warehouse.scd2_close(
        history(spark, sf_dir), staged_versions(spark, sf_dir), now(), compare=["segment"]
    )


@plan(
    HISTORY_SQL
    + """SELECT id, uuid, segment, current AS "rowIsCurrent", ended AS "rowEndDate" FROM after_load
    UNION ALL
    SELECT -1, uuid, segment, true, NULL FROM stage
    WHERE uuid NOT IN (SELECT uuid FROM after_load WHERE current)"""
)
def scd2_apply(spark, sf_dir):
    """New versions, whose id the target would assign, are shown with id -1."""
    name = stored(spark, history(spark, sf_dir), ["uuid"], unique=False)
    keyed.load_history(spark, name, staged_versions(spark, sf_dir), now(), compare=["segment"])
    return spark.table(name).withColumn("id", F.coalesce("id", F.lit(-1)))


@plan(
    HISTORY_SQL
    + """SELECT uuid, segment, current AS "rowIsCurrent" FROM after_load
    UNION ALL
    SELECT uuid, segment, true FROM stage WHERE uuid NOT IN (SELECT uuid FROM after_load WHERE current)"""
)
def scd2_apply_spread(spark, sf_dir):
    """The load of a dimension whose current rows may repeat a key: hot keys are spread over tasks."""
    after = warehouse.scd2_apply(
        history(spark, sf_dir), staged_versions(spark, sf_dir), now(), compare=["segment"]
    )
    return after.select("uuid", "segment", "rowIsCurrent")


def audit_rows(spark, sf_dir):
    """Audit rows of five jobs, one row per event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("dag"),
        F.when(F.col("value") > 100, "Success")
        .when(F.col("value") < 5, "FAILED")
        .otherwise("RUNNING")
        .alias("status"),
        F.col("ts").alias("start_at"),
        (F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("finished_at"),
        F.col("props").alias("information"),
    )


AUDIT_SQL = """WITH audit AS (
    SELECT event_type AS dag,
        CASE WHEN value > 100 THEN 'Success' WHEN value < 5 THEN 'FAILED' ELSE 'RUNNING' END AS status,
        ts AS start_at, ts + INTERVAL 1 MINUTE AS finished_at, props AS information
    FROM events)
"""


@plan(
    AUDIT_SQL
    + """SELECT dag, max(finished_at) AS finished_at FROM audit
    WHERE upper(status) = 'SUCCESS' GROUP BY dag"""
)
def audit_latest(spark, sf_dir):
    return audits.latest_loads(audit_rows(spark, sf_dir))


@plan(
    AUDIT_SQL
    + """SELECT event_id, ts FROM events
    WHERE ts > (SELECT max(finished_at) FROM audit WHERE upper(status) = 'SUCCESS' AND dag = 'purchase')"""
)
def filter_newest(spark, sf_dir):
    latest = audits.latest_load(audit_rows(spark, sf_dir), "purchase")
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    return audits.filter_newest(events, "ts", latest)


@plan(
    AUDIT_SQL
    + f""", marked AS (
    SELECT *, dag = 'purchase' AND start_at =
        (SELECT max(start_at) FROM audit WHERE dag = 'purchase') AS hit FROM audit)
    SELECT dag, CASE WHEN hit THEN 'SUCCESS' ELSE status END AS status, start_at,
        CASE WHEN hit THEN TIMESTAMP '{NOW}' ELSE finished_at END AS finished_at,
        CASE WHEN hit THEN 'All tasks are successfull: extract, load, ' ELSE information END
            AS information
    FROM marked"""
)
def audit_close(spark, sf_dir):
    return audits.close_load(
        audit_rows(spark, sf_dir), "purchase", audits.SUCCESS, "extract, load, ", now()
    )


@plan(
    """WITH flags AS (
    SELECT CAST(user_id AS VARCHAR) AS dag, event_type AS position,
        CASE WHEN max(value) >= 60 THEN event_type END AS task
    FROM events GROUP BY user_id, event_type)
    SELECT dag, CASE WHEN bool_and(task IS NOT NULL) THEN 'RUNNING' ELSE 'FAILED' END AS status,
        CASE WHEN bool_and(task IS NOT NULL) THEN 'All tasks are successfull: '
            ELSE 'Error some task ' END
            || coalesce(string_agg(task || ', ', '' ORDER BY position), '') AS information
    FROM flags GROUP BY dag"""
)
def audit_fold(spark, sf_dir):
    """A run per user, with one flag per kind of event; weak kinds are missing."""
    flags = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").cast("string").alias("dag"), F.col("event_type").alias("position"))
        .agg(F.max("value").alias("_largest"))
        .select("dag", "position", F.when(F.col("_largest") >= 60, F.col("position")).alias("task"))
    )
    return audits.fold_flags(flags)
