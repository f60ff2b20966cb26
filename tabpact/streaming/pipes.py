"""Pipelines on streams."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..errors import raise_if
from ..operators.checks import check_summary, enforce
from ..sinks.publish import Pending, PendingFolder, publish_all
from ..staging import stage, temporary_folders
from .sinks import prepare_batch

if TYPE_CHECKING:
    from ..plans.pipeline import Pipeline

#: From the rows of a batch as read to rows and rejects.
Split = Callable[[DataFrame], tuple[DataFrame, DataFrame | None]]
COUNTS = "batch_id bigint, scope string, column string, check_id string, explain string, tested bigint, failed bigint, skipped bigint"


def counts_path(checkpoint: str, source: str) -> str:
    return f"{checkpoint}/counts_{source}"


def run_pipeline(pipeline: Pipeline, spark: SparkSession, checkpoint: str, **trigger: Any) -> list[StreamingQuery]:
    """Start one query for all sources and sinks that pipes connect, so that every source is read once.

    Filters, checks, policies and mappings are those of the batch run. The rows of a micro-batch are written to the shared folder once; the sinks, the counts of
    the checks, rejects and bad rows are all made of them, under the same batch id. Outputs are shown when all of a batch are written, one after
    another, and each leaves a mark under the checkpoint: a batch that is repeated because the run was stopped in between makes only those that are missing.
    Rejects and bad rows are folders ``batch_id=<n>``. See :func:`check_counts`.
    """
    pipeline.validate()
    unstreamable = [
        b.name for b in pipeline.sources.values() if (b.fmt == "table" if b.custom is None else b.custom.stream_fn is None)
    ]
    raise_if(f"pipeline {pipeline.name!r}", [f"source {n!r} cannot be read as a stream" for n in unstreamable])
    queries: list[StreamingQuery] = []
    for sources, sinks in _connected(pipeline):
        parts = {name: pipeline.sources[name].stream_parts(spark) for name in sources}
        for sink_name in sinks:
            rows = [split(_empty(spark, stream.schema))[0] for stream, split in (parts[a] for a in pipeline._targets()[sink_name])]
            pipeline.sinks[sink_name].check(reduce(DataFrame.unionByName, rows))
        name = next(iter(sinks))
        writer = _packed({a: stream for a, (stream, _) in parts.items()}).writeStream.option("checkpointLocation", f"{checkpoint}/{name}/query")
        writer = writer.queryName(f"{pipeline.name}_{name}").trigger(**(trigger or {"availableNow": True}))
        each = _batch_writer(pipeline, {a: (stream.schema, split) for a, (stream, split) in parts.items()}, sinks, checkpoint)
        queries.append(writer.foreachBatch(each).start())
    return queries


def _connected(pipeline: Pipeline) -> list[tuple[list[str], list[str]]]:
    """Sources and sinks that pipes join, directly or through others."""
    groups: list[tuple[dict[str, None], dict[str, None]]] = []
    for a, b in pipeline.pipes:
        met = [g for g in groups if a in g[0] or b in g[1]]
        sources, sinks = {a: None}, {b: None}
        for g in reversed(met):
            sources, sinks = g[0] | sources, g[1] | sinks
            groups.remove(g)
        groups.append((sources, sinks))
    return [(list(sources), list(sinks)) for sources, sinks in groups]


def _empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def _packed(streams: dict[str, DataFrame]) -> DataFrame:
    """One stream of several sources: a row is a struct in the column of its source."""
    rows = [stream.select(F.lit(name).alias("source"), F.struct(*stream.columns).alias(f"rows_{name}")) for name, stream in streams.items()]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), rows)


def _batch_writer(pipeline: Pipeline, parts: dict[str, tuple[T.StructType, Split]], sinks: list[str], checkpoint: str) -> Any:
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = _Marks(spark, f"{checkpoint}/{sinks[0]}/done", batch_id)
        pending: dict[str, Pending] = {}
        with temporary_folders(spark):
            staged = stage(batch, "batch")
            try:
                good: dict[str, DataFrame] = {}
                for name, (_, split) in parts.items():
                    binding = pipeline.sources[name]
                    rows, rejects = split(staged.where(F.col("source") == name).select(f"rows_{name}.*"))
                    good[name], bad = enforce(rows, binding.contract, binding.policy, binding.key)
                    counts = check_summary(rows, binding.contract, with_rows=True).coalesce(1)
                    for label, path, table in (
                        (f"rejects of {name}", binding.rejects_path, rejects),
                        (f"bad of {name}", binding.bad_path, bad),
                        (f"counts of {name}", counts_path(checkpoint, name), counts),
                    ):
                        if table is not None and path is not None and not log.has(label):
                            pending[label] = _pending_table(table, f"{path}/batch_id={batch_id}")
                for sink_name in sinks:
                    if not log.has(sink_name):
                        rows = reduce(DataFrame.unionByName, [good[a] for a in pipeline._targets()[sink_name]])
                        pending[sink_name] = prepare_batch(rows, pipeline.sinks[sink_name], f"{checkpoint}/{sink_name}", batch_id)
            except BaseException:
                for output in pending.values():
                    output.cancel()
                raise
            publish_all({label: Pending(log.after(label, output.publish), output.cancel) for label, output in pending.items()})

    return write


class _Marks:
    """Which outputs of a batch are there, as empty files under the checkpoint; those of the batch before the last are removed."""

    def __init__(self, spark: SparkSession, folder: str, batch_id: int):
        path = spark._jvm.org.apache.hadoop.fs.Path
        self.path = lambda label: path(f"{folder}/{batch_id}", label.replace(" ", "-"))
        self.files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.delete(path(f"{folder}/{batch_id - 2}"), True)

    def has(self, label: str) -> bool:
        return self.files.exists(self.path(label))

    def after(self, label: str, publish: Callable[[], Any]) -> Callable[[], Any]:
        def published() -> Any:
            outcome = publish()
            self.files.create(self.path(label), True).close()
            return outcome

        return published


def _pending_table(df: DataFrame, path: str) -> Pending:
    folder = PendingFolder(df.sparkSession, path, "overwrite")
    df.write.parquet(folder.path)
    return Pending(folder.publish, folder.cancel)


def check_counts(spark: SparkSession, checkpoint: str, source: str) -> DataFrame:
    """Per batch and check the rows tested, failed and skipped, of all batches so far.

    The row with ``scope`` "rows" has the number of rows of the batch. The counts are a table under the
    checkpoint, so none is ever dropped, and they outlive the query.
    """
    if not any(f.getPath().getName().startswith("batch_id=") for f in _children(spark, counts_path(checkpoint, source))):
        return spark.createDataFrame([], COUNTS)
    table = spark.read.schema(COUNTS).parquet(counts_path(checkpoint, source))
    return table.select(*[F.col(c.split(" ")[0]) for c in COUNTS.split(", ")])


def _children(spark: SparkSession, path: str) -> list[Any]:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return list(files.listStatus(target)) if files.exists(target) else []
