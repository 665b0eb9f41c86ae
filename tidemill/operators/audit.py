"""Load audit: high-water marks, closing a run, folding task flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States and message starts of the audit table.
SUCCESS = "SUCCESS"
FAILED = "FAILED"
FAILED_MESSAGE = "Error some task "
SUCCESS_MESSAGE = "All tasks are successfull: "


class LoadFailed(RuntimeError):
    """A load whose audit row was closed as failed."""


def successful_loads(audit: DataFrame) -> DataFrame:
    return audit.filter(F.upper("status") == SUCCESS)


def latest_loads(audit: DataFrame, finished: str = "finished_at") -> DataFrame:
    """Latest successful finish time of every job that has one."""
    return successful_loads(audit).groupBy("dag").agg(F.max(finished).alias(finished))


def latest_load(audit: DataFrame, job: str, finished: str = "finished_at") -> str | None:
    """Latest successful finish time of one job: a single value on the driver.

    As text in the session's time zone, so that no other time zone comes in.
    """
    latest = successful_loads(audit).filter(F.col("dag") == job).agg(F.max(finished).alias("at"))
    return latest.select(F.col("at").cast("string")).collect()[0][0]


def filter_newest(
    df: DataFrame, moment: str, latest: str | None, strict: bool = False
) -> DataFrame:
    """Rows after ``latest``, which reaches the scan as a literal filter.

    Before the first successful load ``latest`` is None and all rows are kept;
    ``strict`` keeps none, as a comparison with null does.
    """
    if latest is None:
        return df.limit(0) if strict else df
    kind = df.schema[moment].dataType.typeName()
    if kind not in ("timestamp", "timestamp_ntz"):
        kind = "timestamp"
    return df.filter(F.col(moment).cast(kind) > F.lit(latest).cast(kind))


def load_message(status: str, tasks: str) -> str:
    return (FAILED_MESSAGE if status == FAILED else SUCCESS_MESSAGE) + tasks


def close_load(audit: DataFrame, job: str, status: str, tasks: str, now: Column) -> DataFrame:
    """The audit table with the latest row of ``job`` finished.

    The latest start is one row, so it is broadcast to the table.
    """
    latest = audit.filter(F.col("dag") == job).agg(F.max("start_at").alias("_latest"))
    latest = latest.select(F.lit(job).alias("dag"), F.col("_latest").alias("start_at"))
    latest = latest.withColumn("_hit", F.lit(True))
    values = {
        "finished_at": now,
        "information": F.lit(load_message(status, tasks)),
        "status": F.lit(status),
    }
    joined = audit.join(F.broadcast(latest), on=["dag", "start_at"], how="left")
    return joined.select(
        *[
            F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
            for c in audit.columns
        ]
    )


def stop_if_failed(status: str, job: str) -> None:
    if status == FAILED:
        raise LoadFailed(f"load {job} failed")


def fold_flags(flags: DataFrame, finished_status: str = "RUNNING") -> DataFrame:
    """One audit message and status per job from its task flags.

    flags: dag, position, task; a null task is a missing flag and fails the job.
    Names are listed in the order of position. A job has as many flags as its
    definition has tasks.
    """
    folded = flags.groupBy("dag").agg(
        F.bool_and(F.col("task").isNotNull()).alias("_complete"),
        F.sort_array(
            F.collect_list(F.when(F.col("task").isNotNull(), F.struct("position", "task")))
        ).alias("_flags"),
    )
    names = F.concat_ws("", F.transform("_flags", lambda f: F.concat(f["task"], F.lit(", "))))
    status = F.when(F.col("_complete"), F.lit(finished_status)).otherwise(F.lit(FAILED))
    start = F.when(F.col("_complete"), F.lit(SUCCESS_MESSAGE)).otherwise(F.lit(FAILED_MESSAGE))
    return folded.select("dag", status.alias("status"), F.concat(start, names).alias("information"))
