from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemill.operators import audit

SCHEMA = (
    "dag string, status string, start_at timestamp_ntz, finished_at timestamp_ntz, information string"
)


def now():
    return F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")



def day(n):
    return datetime(2024, 1, n)


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(
        [
            ("a", "Success", day(1), day(2), "x"),
            ("a", "SUCCESS", day(3), day(4), "x"),
            ("a", "FAILED", day(5), day(6), "x"),
            ("b", "success", day(7), day(8), "x"),
            ("c", "RUNNING", day(9), None, None),
        ],
        SCHEMA,
    )


def test_latest_load_ignores_case_and_other_states(log):
    assert audit.latest_load(log, "a") == "2024-01-04 00:00:00"
    assert audit.latest_load(log, "c") is None
    assert {r["dag"]: r["finished_at"] for r in audit.latest_loads(log).collect()} == {
        "a": day(4),
        "b": day(8),
    }


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "string"])
def test_filter_newest(spark, log, kind):
    df = spark.createDataFrame([(day(n),) for n in range(1, 8)], "at timestamp_ntz").select(
        F.col("at").cast(kind)
    )
    assert audit.filter_newest(df, "at", audit.latest_load(log, "a")).count() == 3
    assert audit.filter_newest(df, "at", None).count() == 7
    assert audit.filter_newest(df, "at", None, strict=True).count() == 0


def test_filter_newest_reaches_the_scan(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    plan = audit.filter_newest(events, "ts", "2024-01-20 00:00:00")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts,2024-01-20" in text


def test_close_load_changes_the_latest_row_of_the_job_only(log):
    closed = audit.close_load(log, "a", audit.FAILED, "load, ", now())
    assert closed.columns == log.columns
    rows = {(r["dag"], r["start_at"]): r for r in closed.collect()}
    assert len(rows) == 5
    assert rows["a", day(5)]["information"] == "Error some task load, "
    assert rows["a", day(5)]["finished_at"] == datetime(2024, 6, 1, 12)
    assert rows["a", day(3)]["information"] == "x"
    done = audit.close_load(log, "c", audit.SUCCESS, "load, ", now()).where("dag = 'c'").collect()
    assert done[0]["status"] == "SUCCESS"
    assert done[0]["information"] == "All tasks are successfull: load, "
    assert audit.close_load(log, "none", audit.SUCCESS, "", now()).collect() == log.collect()


def test_stop_if_failed():
    audit.stop_if_failed("SUCCESS", "a")
    with pytest.raises(audit.LoadFailed):
        audit.stop_if_failed("FAILED", "a")


def test_fold_flags(spark):
    flags = spark.createDataFrame(
        [("a", 2, "load"), ("a", 1, "extract"), ("b", 1, "extract"), ("b", 2, None), ("c", 1, None)],
        "dag string, position int, task string",
    )
    folded = {r["dag"]: (r["status"], r["information"]) for r in audit.fold_flags(flags).collect()}
    assert folded == {
        "a": ("RUNNING", "All tasks are successfull: extract, load, "),
        "b": ("FAILED", "Error some task extract, "),
        "c": ("FAILED", "Error some task "),
    }
