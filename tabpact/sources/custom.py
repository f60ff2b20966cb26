"""Sources whose rows come from user code."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from ..errors import raise_if
from ..staging import qualified

#: Rejects that a slice holds until its first row shows whether it yields tuples or batches.
HELD_REJECTS = 1_000
#: Stands for a slice where none is left; a source has one partition at least.
_NOTHING = "tabpact: no slice"


#: The column in which a source says why a record is no row: NULL for a row, else the record and the reason.
REJECT = "_reject"
REJECT_TYPE = "struct<record:string,reason:string>"


@dataclass(frozen=True)
class Reject:
    """What a reader yields in place of a row for a record that it cannot read."""

    record: str
    reason: str


@dataclass(frozen=True)
class CustomSource:
    """A named function that builds a DataFrame from filter values.

    With ``rejects`` its frames have the column ``REJECT`` as well.
    """

    name: str
    fn: Callable[..., DataFrame]
    stream_fn: Callable[..., DataFrame] | None = None
    rejects: bool = False

    def load_tagged(self, spark: SparkSession, stream: bool = False, **filters: Any) -> DataFrame:
        """Rows and rejects in one frame, as the function gives them."""
        if stream:
            raise_if(f"source {self.name!r}", [] if self.stream_fn else ["it cannot be read as a stream"])
        return (self.stream_fn if stream else self.fn)(spark, **filters)

    def load_stream(self, spark: SparkSession, **filters: Any) -> DataFrame:
        """The rows as a stream, for a source that has one. A reject stops the query."""
        found = self.load_tagged(spark, True, **filters)
        return self._without_rejects(found) if self.rejects else found

    def load(self, spark: SparkSession, **filters: Any) -> DataFrame:
        """The rows. A reject fails the job."""
        found = self.load_tagged(spark, **filters)
        return self._without_rejects(found) if self.rejects else found

    def _without_rejects(self, tagged: DataFrame) -> DataFrame:
        reject = F.col(REJECT)
        message = F.concat(F.lit(f"source {self.name}: "), reject["reason"], F.lit(": "), F.coalesce(reject["record"], F.lit("")))
        return tagged.where(F.when(reject.isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).drop(REJECT)


def split_tagged(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows, and the rejects as ``record`` and ``reason``."""
    return tagged.where(F.col(REJECT).isNull()).drop(REJECT), tagged.where(F.col(REJECT).isNotNull()).select(f"{REJECT}.*")


def custom_source(
    name: str, fn: Callable[..., DataFrame], stream_fn: Callable[..., DataFrame] | None = None, rejects: bool = False
) -> CustomSource:
    """Wrap ``fn(spark, **filters) -> DataFrame`` as a source; ``stream_fn`` gives the same rows as a stream.

    With ``rejects`` the frames have a column ``REJECT`` of type ``REJECT_TYPE`` that is not NULL for records which are no rows.
    Such records go to the ``rejects_path`` of the source's binding, or fail the job where there is none.
    """
    raise_if(f"source {name!r}", [] if name.isidentifier() else ["the name is not an identifier"])
    return CustomSource(name, fn, stream_fn, rejects)


@dataclass
class _Slice(InputPartition):
    value: Any


def _tagged(found: Iterable[Any], width: int) -> Iterator[Any]:
    """What a reader yields, with the reject column; all tuples or all batches, as the first row says."""
    held: list[Reject] = []
    of_reject = lambda r: (*[None] * width, (str(r.record), str(r.reason)))
    found = iter(found)
    for first in found:
        if not isinstance(first, Reject):
            break
        held.append(first)
        if len(held) == HELD_REJECTS:
            # Nothing but rejects so far: from here on all are tuples.
            yield from map(of_reject, held)
            yield from _as_tuples(found, of_reject)
            return
    else:
        yield from map(of_reject, held)
        return
    if not isinstance(first, pa.RecordBatch):
        yield from map(of_reject, held)
        yield (*first, None)
        yield from _as_tuples(found, of_reject)
        return
    kind = pa.struct([("record", pa.string()), ("reason", pa.string())])

    def as_batch(item: Any) -> pa.RecordBatch:
        if isinstance(item, pa.RecordBatch):
            return pa.RecordBatch.from_arrays([*item.columns, pa.nulls(item.num_rows, kind)], names=[*item.schema.names, REJECT])
        tag = pa.array([{"record": str(item.record), "reason": str(item.reason)}], kind)
        return pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in first.schema), tag], names=[*first.schema.names, REJECT])

    yield from map(as_batch, (*held, first))
    yield from map(as_batch, found)


def _as_tuples(found: Iterator[Any], of_reject: Callable[[Reject], tuple]) -> Iterator[tuple]:
    for item in found:
        if isinstance(item, Reject):
            yield of_reject(item)
        elif isinstance(item, pa.RecordBatch):
            yield from ((*row, None) for row in zip(*(c.to_pylist() for c in item.columns)))
        else:
            yield (*item, None)


#: What a filter on one column says of a slice with values between two bounds.
_MAY_HOLD: dict[type[Filter], Callable[[Any, Any, Any], bool]] = {
    EqualTo: lambda lo, hi, v: lo <= v <= hi,
    GreaterThan: lambda lo, hi, v: hi > v,
    GreaterThanOrEqual: lambda lo, hi, v: hi >= v,
    LessThan: lambda lo, hi, v: lo < v,
    LessThanOrEqual: lambda lo, hi, v: lo <= v,
    In: lambda lo, hi, vs: any(v is not None and lo <= v <= hi for v in vs),
}


def may_hold(bounds: Mapping[str, tuple[Any, Any]], filters: Iterable[Filter]) -> bool:
    """Whether a slice within ``bounds`` (least and greatest value by column) can have a row that all filters let through."""
    for one in filters:
        test, column = _MAY_HOLD.get(type(one)), getattr(one, "attribute", ())
        if test is None or len(column) != 1 or column[0] not in bounds:
            continue
        if not test(*bounds[column[0]], one.value):
            return False
    return True


class _Log:
    """Which slices each batch of a stream has taken, as files in the shared folder; a slice is known by its text."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.files, self.root = fs.FileSystem.from_uri(uri)
        self.files.create_dir(self.root)
        found = self.files.get_file_info(fs.FileSelector(self.root))
        self.last = max((int(f.base_name) for f in found if f.base_name.isdigit()), default=0)
        self.known = {repr(s) for n in range(1, self.last + 1) for s in self.read(n)}

    def read(self, number: int) -> list[Any]:
        with self.files.open_input_file(f"{self.root}/{number}") as raw:
            return cloudpickle.loads(raw.read())

    def take(self, slices: Sequence[Any]) -> None:
        """Log those of the slices that are new, as the next batch."""
        new = list({repr(s): s for s in slices if repr(s) not in self.known}.values())
        if not new:
            return
        # First beside its place: a batch is there whole or not at all.
        with self.files.open_output_stream(f"{self.root}/_{self.last + 1}") as out:
            out.write(cloudpickle.dumps(new))
        self.files.move(f"{self.root}/_{self.last + 1}", f"{self.root}/{self.last + 1}")
        self.last += 1
        self.known |= {repr(s) for s in new}


def record_source(
    name: str,
    schema: str | T.StructType,
    slices: Sequence[Any] | Callable[[], Sequence[Any]],
    read: Callable[..., Iterator[Any]],
    bounds: Callable[[Any], Mapping[str, tuple[Any, Any]]] | None = None,
    log: str | None = None,
) -> CustomSource:
    """A source of records that user code yields slice by slice, one Spark partition per slice.

    ``read(slice, **filters)`` runs on an executor and yields tuples in schema order or Arrow record
    batches; batches are much cheaper. In their place it may yield a :class:`Reject` for a record that it cannot
    read, and go on. It gets the bound value of every filter of the contract, None for
    one that is not set. A slice is read again if its task is retried.

    ``slices`` may be a function that lists them. On a stream it is asked for each micro-batch, which takes the slices that
    have come since the last one; new slices must come after those listed before. With a ``log``, a folder for one query alone,
    the slices taken are kept there instead, so that they may be listed in any order.

    ``bounds`` gives the least and the greatest value of some columns in a slice. Slices that the filters on the rows rule out are then not opened;
    what they would reject is not seen either.
    """
    listed = slices if callable(slices) else lambda: slices
    fields = (T.DataType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    width = len(fields)
    raise_if(f"source {name!r}", [f"the column {REJECT!r} is taken"] if REJECT in [f.name.lower() for f in fields] else [])
    tagged = T.StructType([*(T.StructField(f.name, f.dataType, True, f.metadata) for f in fields), T.StructField(REJECT, T.DataType.fromDDL(REJECT_TYPE))])

    class Reader(DataSourceReader):
        def __init__(self, filters):
            self.filters = filters

        def partitions(self):
            return [_Slice(s) for s in listed()]

        def read(self, partition):
            yield from _tagged(read(partition.value, **self.filters), width)

    class PruningReader(Reader):
        def __init__(self, filters):
            super().__init__(filters)
            self.pushed = []

        def pushFilters(self, filters):
            self.pushed = [f for f in filters if type(f) in _MAY_HOLD]
            # A slice has other rows as well, so Spark looks at each row again.
            yield from filters

        def partitions(self):
            kept = [s for s in listed() if may_hold(bounds(s), self.pushed)]
            return [_Slice(s) for s in kept] or [_Slice(_NOTHING)]

        def read(self, partition):
            return iter(()) if partition.value == _NOTHING else super().read(partition)

    class LoggedReader(DataSourceStreamReader):
        def __init__(self, filters, uri):
            self.filters, self.log = filters, _Log(uri)

        def initialOffset(self):
            return {"batch": 0}

        def latestOffset(self):
            self.log.take(listed())
            return {"batch": self.log.last}

        def partitions(self, start, end):
            return [_Slice(s) for n in range(start["batch"] + 1, end["batch"] + 1) for s in self.log.read(n)]

        def read(self, partition):
            yield from _tagged(read(partition.value, **self.filters), width)

        def commit(self, end):
            pass

    class StreamReader(DataSourceStreamReader):
        def __init__(self, filters):
            self.filters = filters

        def initialOffset(self):
            return {"slices": 0}

        def latestOffset(self):
            return {"slices": len(listed())}

        def partitions(self, start, end):
            return [_Slice(s) for s in listed()[start["slices"] : end["slices"]]]

        def read(self, partition):
            yield from _tagged(read(partition.value, **self.filters), width)

        def commit(self, end):
            pass

    def register(spark: SparkSession, filters: dict[str, Any]) -> None:
        uri = None if log is None else qualified(spark, log)
        if bounds is not None:
            # Without it Spark refuses a reader that looks at filters.
            spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

        class Source(DataSource):
            @classmethod
            def name(cls):
                return name

            def schema(self):
                return tagged

            def reader(self, schema):
                return Reader(filters) if bounds is None else PruningReader(filters)

            def streamReader(self, schema):
                return StreamReader(filters) if uri is None else LoggedReader(filters, uri)

        spark.dataSource.register(Source)

    def load(spark: SparkSession, **filters: Any) -> DataFrame:
        register(spark, filters)
        return spark.read.format(name).load()

    def load_stream(spark: SparkSession, **filters: Any) -> DataFrame:
        register(spark, filters)
        return spark.readStream.format(name).load()

    return custom_source(name, load, load_stream, rejects=True)
