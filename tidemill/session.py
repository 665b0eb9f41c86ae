"""Session settings shared by every job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession

ROCKSDB_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session_settings(shuffle_partitions: int | None = None) -> dict[str, str]:
    """The settings the jobs rely on.

    The shuffle width is an upper limit that AQE coalesces at run time, so a
    cluster passes a large one. Streaming state goes to RocksDB because the
    default store keeps every key on the executor heap.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB_STATE,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return settings


def build_session(
    app_name: str,
    master: str | None = None,
    *,
    executor_memory: str | None = None,
    shuffle_partitions: int | None = None,
    warehouse_dir: str | None = None,
    metastore_uri: str | None = None,
    packages: Sequence[str] = (),
    extra: Mapping[str, str] | None = None,
) -> SparkSession:
    """Get or create the session; unset arguments are left to spark-defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = session_settings(shuffle_partitions)
    if executor_memory:
        settings["spark.executor.memory"] = executor_memory
    if warehouse_dir:
        settings["spark.sql.warehouse.dir"] = warehouse_dir
    if metastore_uri:
        settings["spark.hadoop.hive.metastore.uris"] = metastore_uri
    if packages:
        settings["spark.jars.packages"] = ",".join(packages)
    settings.update(extra or {})
    for name, value in settings.items():
        builder = builder.config(name, value)
    if metastore_uri:
        builder = builder.enableHiveSupport()
    return builder.getOrCreate()
