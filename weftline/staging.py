"""Intermediate tables in the folder that driver and executors share.

A staged table cuts lineage: it is Parquet under ``spark.checkpoint.dir``, so a
lost executor costs the running tasks only. Without that setting a folder of
this machine is used, and only where driver and executors are one process.

What is made here is deleted when the driver's JVM ends, or before: by ``drop``, by
``release`` for all that was made since a mark, or by ``clear``.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_staged: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in plain local mode, where it is unset, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="weftline-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return "file://" + _local[0]


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/weftline-{tag}-{uuid.uuid4().hex}"
    _staged.append(path)
    with contextlib.suppress(Exception):  # a file system may not offer it
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _forget(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        _delete(spark, path)
        if path in _staged:
            _staged.remove(path)


def drop(*staged: DataFrame) -> None:
    """Deletes staged tables that no later plan reads."""
    for df in staged:
        if path := getattr(df, "_staged_at", None):
            _forget(df.sparkSession, [path])


def mark() -> int:
    """How many tables are staged now."""
    return len(_staged)


def release(spark: SparkSession, since: int, keep: DataFrame | None = None) -> None:
    """Deletes all that was staged since a mark but ``keep``."""
    _forget(spark, [p for p in _staged[since:] if p != getattr(keep, "_staged_at", None)])


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this process has staged, once their results are written elsewhere."""
    release(spark, 0)
