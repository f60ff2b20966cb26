"""Tables written between the steps of a job, so that a lost executor does not undo earlier steps.

They go to the shared folder that the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache
from threading import Lock

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_freeing: dict[int, tuple[int, str | None]] = {}
_freeing_lock = Lock()
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables.

    Only a local session may go without the setting; it then gets a temporary folder, the same one
    for the rest of the process. On a cluster that would be local to one machine, so it is refused.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
    return _local_folder()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tabpact-")


def application_folder(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables."""
    return f"{shared_folder(spark)}/tabpact/{spark.conf.get('spark.app.id', 'application')}"


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path for one operator run."""
    path = f"{application_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if _made.get() is not None:
        _made.get().append(path)
    return path


@contextmanager
def temporary_folders(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made within are removed at the end: for jobs whose output is written by then."""
    mine: list[str] = []
    before = _made.set(mine)
    try:
        yield
    finally:
        _made.reset(before)
        for path in mine:
            remove(spark, path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the tables staged within are removed as soon as a table is written, not when the driver next collects garbage.

    A frame that is made within and read by an action frees its shuffles as well, so results are to be made outside.
    """
    key = id(spark._jsparkSession)
    with _freeing_lock:
        users, before = _freeing.get(key, (0, spark.conf.get(FREE_SHUFFLES, None)))
        _freeing[key] = (users + 1, before)
        spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        with _freeing_lock:
            users, before = _freeing.pop(key)
            if users > 1:
                _freeing[key] = (users - 1, before)
            elif before is None:
                spark.conf.unset(FREE_SHUFFLES)
            else:
                spark.conf.set(FREE_SHUFFLES, before)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of the file system that Spark takes it for."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def remove_staged(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that still read them become invalid."""
    remove(spark, application_folder(spark))


def stage(df: DataFrame, label: str, rows_per_file: int = 0) -> DataFrame:
    """Write a frame as parquet and read it back, which also ends its lineage."""
    return stage_at(df, new_folder(df.sparkSession, label), None, rows_per_file)[0]


def stage_at(df: DataFrame, path: str, counted: Column | None = None, rows_per_file: int = 0) -> tuple[DataFrame, int]:
    """Stage to a path and count, in the same job, the rows or the rows for which ``counted`` is true.

    With ``rows_per_file`` a task that writes more rows than that makes several files, so that those who read them share the work however the
    frame was partitioned. A stage that Spark runs again may be counted again, so only zero is exact.
    """
    seen = Observation()
    rows = F.count(F.lit(1)) if counted is None else F.count_if(counted)
    df.observe(seen, rows.alias("rows")).write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["rows"]
