"""Session helpers: a local session for tests and benchmarks, the shared folder, staged tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """Local session with the settings the benchmark and the tests use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("skylattice")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SKYLATTICE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor reaches: the one named in ``spark.checkpoint.dir``.

    Only on a local master, where all tasks see the same disk, a temporary folder stands in.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="skylattice-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return folder


def checkpointing(spark: SparkSession) -> None:
    """Give iterative fits a folder for their checkpoints, so lost executors cost little."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))


#: While a table is written, what was exchanged for it is given back as soon as it is written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writers, _before, _lock = 0, None, threading.Lock()


@contextmanager
def _frugal(spark: SparkSession) -> Iterator[None]:
    """Writers side by side share the setting; the last one puts back what was there."""
    global _writers, _before
    with _lock:
        if _writers == 0:
            _before = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _writers += 1
    try:
        yield
    finally:
        with _lock:
            _writers -= 1
            if _writers == 0:
                spark.conf.unset(_CLEANUP) if _before is None else spark.conf.set(_CLEANUP, _before)


def _written(df: DataFrame, path: str) -> DataFrame:
    with _frugal(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def staged(df: DataFrame) -> DataFrame:
    """The table written once to the shared folder and read back.

    For tables that several later steps read: each reads only its columns, none repeats the
    joins behind the table, and a lost executor costs a re-read.
    """
    return _written(df, f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}")


@contextmanager
def staging(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Staged tables that are removed at the end, for steps whose result does not read them any more."""
    folder = f"{shared_folder(spark)}/staging-{uuid.uuid4().hex}"

    def stage(df: DataFrame) -> DataFrame:
        return _written(df, f"{folder}/{uuid.uuid4().hex}")

    try:
        yield stage
    finally:
        remove(spark, folder)
