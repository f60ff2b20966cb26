"""Sinks whose records are taken by user code."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceStreamWriter,
    DataSourceWriter,
    WriterCommitMessage,
)

from ..errors import RefusedError, SealedError, raise_if
from ..staging import new_folder, qualified, remove
from .base import Sink
from .publish import Pending
from .refused import RefusedFile, read_refused, remove_manifest, write_manifest


class RecordWriter(Protocol):
    """Takes the records of one partition. ``put`` may raise, :class:`RefusedError` for a single record; ``done`` is called once at the end and
    returns what ``commit`` needs to publish them."""

    def put(self, row: Any) -> None: ...

    def done(self) -> Any: ...


class SealedAfterDone:
    """Refuses records once the writer is done."""

    def __init__(self, writer: RecordWriter):
        self._writer = writer
        self._closed = False

    def put(self, row: Any) -> None:
        if self._closed:
            raise SealedError("put after done")
        self._writer.put(row)

    def done(self) -> Any:
        if self._closed:
            raise SealedError("done was called before")
        self._closed = True
        return self._writer.done()


@dataclass
class _Done(WriterCommitMessage):
    value: Any
    refused: str | None = None


def _keep(uri: str, messages: Sequence[_Done]) -> None:
    """Write a job's results where the driver finds them."""
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(uri)
    files.create_dir(root)
    with files.open_output_stream(f"{root}/messages") as out:
        out.write(cloudpickle.dumps([(m.value, m.refused) for m in messages]))


def _kept(uri: str) -> list[_Done]:
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(uri)
    with files.open_input_file(f"{root}/messages") as raw:
        return [_Done(value, refused) for value, refused in cloudpickle.loads(raw.read())]


@dataclass(frozen=True)
class CustomSink(Sink):
    """A named sink made of functions; see :func:`custom_sink`."""

    name: str
    open_writer: Callable[[int, int], RecordWriter]
    on_commit: Callable[[list[Any]], None] | None = None
    on_abort: Callable[[list[Any]], None] | None = None
    mode: str = "errorifexists"
    rejects_path: str | None = None
    _writes: list[None] = field(default_factory=list, repr=False, compare=False)

    def _publish(self, rejects: str | None, messages: Sequence[_Done], *batch: int) -> None:
        """First the manifest of the refused records, then the user's commit; what the latter refuses is not published."""
        name = str(batch[0]) if batch else uuid.uuid4().hex
        if rejects is not None:
            write_manifest(rejects, name, [m.refused for m in messages if m.refused])
        try:
            if self.on_commit is not None:
                self.on_commit([m.value for m in messages], *batch)
        except BaseException:
            if rejects is not None and not batch:
                remove_manifest(rejects, name)
            raise

    def data_source(self, spark: SparkSession, kept_at: str | None = None) -> type[DataSource]:
        """The sink as a Spark data source for batch and streaming writes; with ``kept_at`` a batch is not committed but its results are left there."""
        sink = self
        rejects = None if self.rejects_path is None else qualified(spark, self.rejects_path)
        open_writer, on_abort, publish = self.open_writer, self.on_abort, CustomSink(self.name, self.open_writer, self.on_commit)._publish

        class Target:
            def write(self, iterator):
                task = TaskContext.get()
                writer = SealedAfterDone(open_writer(task.partitionId(), task.taskAttemptId()))
                refused = None if rejects is None else RefusedFile(rejects)
                for row in iterator:
                    try:
                        writer.put(row)
                    except RefusedError as exc:
                        if refused is None:
                            raise
                        refused.add(row, str(exc))
                return _Done(writer.done(), refused and refused.done())

            def commit(self, messages, *batch):
                done = [m for m in messages if m is not None]
                if kept_at is not None:
                    _keep(kept_at, done)
                else:
                    publish(rejects, done, *batch)

            def abort(self, messages, *batch):
                if on_abort is not None:
                    on_abort([m.value for m in messages if m is not None], *batch)

        class BatchTarget(Target, DataSourceWriter):
            pass

        class StreamTarget(Target, DataSourceStreamWriter):
            pass

        class Source(DataSource):
            @classmethod
            def name(cls):
                return sink.name

            def writer(self, schema, overwrite):
                return BatchTarget()

            def streamWriter(self, schema, overwrite):
                return StreamTarget()

        return Source

    def _save(self, df: DataFrame, kept_at: str | None = None, batch: bool = False) -> None:
        if self._writes and not batch and self.mode != "append":
            raise SealedError(f"sink {self.name!r} is done; with mode 'append' it would take more")
        df.sparkSession.dataSource.register(self.data_source(df.sparkSession, kept_at))
        df.write.format(self.name).mode("append").save()

    def write(self, df: DataFrame) -> None:
        """One write; after it the sink is sealed, unless its mode is ``append``."""
        self._save(df)
        self._writes.append(None)

    def prepare(self, df: DataFrame, batch_id: int | None = None) -> Pending:
        """All records are put; ``on_commit`` is called on publishing, ``on_abort`` on cancelling. Both get the number of a micro-batch, which does not seal the sink."""
        spark = df.sparkSession
        folder = qualified(spark, new_folder(spark, "commit"))
        batch = () if batch_id is None else (batch_id,)
        self._save(df, folder, bool(batch))

        def publish() -> None:
            rejects = None if self.rejects_path is None else qualified(spark, self.rejects_path)
            self._publish(rejects, _kept(folder), *batch)
            if not batch:
                self._writes.append(None)
            remove(spark, folder)

        def cancel() -> None:
            if self.on_abort is not None:
                self.on_abort([m.value for m in _kept(folder)], *batch)
            remove(spark, folder)

        return Pending(publish, cancel)

    def refused(self, spark: SparkSession) -> DataFrame:
        """The records that ``put`` refused, as ``record`` (JSON) and ``reason``, of all committed writes."""
        raise_if(f"sink {self.name!r}", [] if self.rejects_path else ["it has no rejects_path"])
        return read_refused(spark, self.rejects_path)


def custom_sink(
    name: str,
    open_writer: Callable[[int, int], RecordWriter],
    on_commit: Callable[..., None] | None = None,
    on_abort: Callable[..., None] | None = None,
    mode: str = "errorifexists",
    rejects_path: str | None = None,
) -> CustomSink:
    """A sink from user code.

    ``open_writer(partition, attempt)`` runs on an executor and returns an object with ``put(row)``
    and ``done()``. A ``put`` that raises :class:`RefusedError` refuses one record: with a ``rejects_path`` the record is kept there with the
    reason and the task goes on, see :meth:`CustomSink.refused`. Any other failure of ``put`` fails its task. Spark may run a task again, or lose an executor
    after ``done``: records must not become visible before ``on_commit(results)``, which is called
    once with the result of ``done`` of exactly one attempt per partition. ``on_abort(results)`` is
    called instead when the job fails. On a stream both also get the batch id, and ``on_commit`` may
    be called again for a batch that was committed just before a failure.

    A sink that has been written is sealed: a second ``write`` raises, unless ``mode`` is ``append``.
    """
    problems = [] if name.isidentifier() else ["the name is not an identifier"]
    problems += [] if mode in ("errorifexists", "append") else [f"mode {mode!r} is neither 'errorifexists' nor 'append'"]
    raise_if(f"sink {name!r}", problems)
    return CustomSink(name, open_writer, on_commit, on_abort, mode, rejects_path)
