"""Folders that the driver and every executor can reach."""

from __future__ import annotations

import atexit
import re
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``.

    A local session without the setting gets a scratch folder; a cluster
    session without it is an error, because a folder of one machine is lost
    with that machine.
    """
    context = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_SETTING, None)
    if root:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(root)
        return root.rstrip("/")
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder all executors can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemill-"))
    return context.getCheckpointDir()


#: Folders given out by ``new_folder``, and what removes them after the session has ended.
_scratch: dict[str, tuple] = {}


def new_folder(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing uses yet.

    It is scratch: ``remove_scratch`` removes it, at the latest when the program ends.
    """
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    _scratch[path] = (context._jvm, context._jsc.hadoopConfiguration())
    return path


@atexit.register
def remove_scratch() -> None:
    """Remove all folders of ``new_folder``; results read from them must have been used."""
    while _scratch:
        path, (jvm, settings) = _scratch.popitem()
        try:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(settings).delete(folder, True)
        except Exception as failed:  # the JVM may be gone by now
            print(f"scratch folder {path} is left: {failed}", file=sys.stderr)


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and read it from there afterwards."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def _hadoop_path(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _hadoop_path(spark, path)
    return fs.exists(hadoop)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _hadoop_path(spark, path)
    return fs.exists(hadoop) and fs.getFileStatus(hadoop).isDirectory()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file; it appears whole, or what was there before stays."""
    fs, final = _hadoop_path(spark, path)
    folder, _, name = path.rpartition("/")
    _, draft = _hadoop_path(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    settings = spark.sparkContext._jsc.hadoopConfiguration()
    final, draft = fs.makeQualified(final), fs.makeQualified(draft)
    hadoop.FileContext.getFileContext(final.toUri(), settings).rename(draft, final, over)


def matching_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern, found in one call."""
    fs, hadoop = _hadoop_path(spark, pattern)
    return [status.getPath().toString() for status in fs.globStatus(hadoop) or []]


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, hadoop = _hadoop_path(spark, path)
    fs.delete(hadoop, True)
