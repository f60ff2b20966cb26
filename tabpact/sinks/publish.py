"""Outputs that are written first and made visible afterwards, so that several appear together or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession

from ..errors import SealedError
from ..staging import remove


class Pending:
    """An output that is written but not visible. ``publish`` shows it and returns what the write returned; ``cancel`` removes it."""

    def __init__(self, publish: Callable[[], Any], cancel: Callable[[], None] = lambda: None):
        self.publish = publish
        self.cancel = cancel


class PendingFolder:
    """A hidden folder beside its target, which it becomes by renaming."""

    def __init__(self, spark: SparkSession, target: str, mode: str):
        self.spark, self.mode = spark, mode
        self.target = spark._jvm.org.apache.hadoop.fs.Path(target)
        self.files = self.target.getFileSystem(spark._jsc.hadoopConfiguration())
        self._refuse_existing()
        parent = self.target.getParent()
        self.hidden = spark._jvm.org.apache.hadoop.fs.Path(parent, f"_pending-{uuid.uuid4().hex}")
        self.path = self.hidden.toString()

    def _refuse_existing(self) -> None:
        if self.mode == "errorifexists" and self.files.exists(self.target):
            raise SealedError(f"the output {self.target.toString()} already exists")

    def publish(self) -> None:
        """Rename; a folder that is appended to gets the files one by one."""
        self._refuse_existing()
        if self.mode == "append" and self.files.exists(self.target):
            for entry in self.files.listStatus(self.hidden):
                name = entry.getPath().getName()
                if not name.startswith(("_", ".")):
                    self._rename(entry.getPath(), self.spark._jvm.org.apache.hadoop.fs.Path(self.target, name))
            remove(self.spark, self.path)
            return
        if self.files.exists(self.target):
            self.files.delete(self.target, True)
        self._rename(self.hidden, self.target)

    def publish_file(self, path: str) -> None:
        """Rename a file to the target."""
        self._refuse_existing()
        if self.files.exists(self.target):
            self.files.delete(self.target, True)
        self._rename(self.spark._jvm.org.apache.hadoop.fs.Path(path), self.target)

    def _rename(self, source: Any, target: Any) -> None:
        if not self.files.rename(source, target):
            raise OSError(f"{source.toString()} cannot become {target.toString()}")

    def cancel(self) -> None:
        remove(self.spark, self.path)


#: Bytes that a task copies in one go.
COPIED = 8 << 20


def join_files(spark: SparkSession, folders: Sequence[str], target: str) -> None:
    """The part files of some folders, in the order of their names, as one file.

    A file system that can join files does so without reading them. In a folder that all executors share as local files, tasks copy the parts
    side by side, each to its place, which follows from the sizes of those before it. Anything else is refused.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    parts = []
    for folder in folders:
        entries = [e for e in files.listStatus(path(folder)) if e.getPath().getName().startswith("part-") and e.getLen()]
        parts += sorted((e.getPath().toString(), e.getLen()) for e in entries)
    if files.getScheme() == "file":
        _copy_side_by_side(spark, parts, target)
        return
    if not parts:
        files.create(path(target)).close()
        return
    files.rename(path(parts[0][0]), path(target))
    if len(parts) > 1:
        sources = spark.sparkContext._gateway.new_array(path, len(parts) - 1)
        for i, (name, _) in enumerate(parts[1:]):
            sources[i] = path(name)
        files.concat(path(target), sources)


def _copy_side_by_side(spark: SparkSession, parts: list[tuple[str, int]], target: str) -> None:
    plain = lambda uri: "/" + uri.split(":", 1)[-1].lstrip("/")
    places = [0, *accumulate(size for _, size in parts)]
    whole = plain(target)
    # Not through Spark's local file system, which would keep check sums of an empty file beside it.
    with open(whole, "wb") as made:
        made.truncate(places[-1])
    if not parts:
        return

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for name, place in zip(rows["name"].to_pylist(), rows["place"].to_pylist()):
                with open(name, "rb") as source, open(whole, "r+b") as out:
                    out.seek(place)
                    while chunk := source.read(COPIED):
                        out.write(chunk)
            yield rows

    rows = spark.createDataFrame([(plain(name), place) for (name, _), place in zip(parts, places)], "name string, place long")
    tasks = min(len(parts), 1_000)
    rows.repartition(tasks).mapInArrow(copy, "name string, place long").write.format("noop").mode("overwrite").save()


def publish_all(pending: dict[str, Pending]) -> dict[str, Any]:
    """Publish in order. If one fails, those after it are cancelled."""
    outcome: dict[str, Any] = {}
    try:
        for name, output in pending.items():
            outcome[name] = output.publish()
    except BaseException:
        for name, output in pending.items():
            if name not in outcome:
                output.cancel()
        raise
    return outcome
