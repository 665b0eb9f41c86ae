"""The named queries, each with the SQL it has to agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


@dataclass(frozen=True)
class Plan:
    name: str
    run: Run
    sql: str | None


PLANS: dict[str, Plan] = {}


def plan(sql: str | None = None, name: str | None = None) -> Callable[[Run], Run]:
    """Register a function, by default under its own name.

    Without ``sql`` only the rows are looked at.
    """

    def register(run: Run) -> Run:
        key = name or run.__name__
        if key in PLANS:
            raise ValueError(f"plan {key} is registered twice")
        PLANS[key] = Plan(key, run, sql)
        return run

    return register


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))
