"""Sinks on a stream, with row numbers carried from batch to batch."""

from __future__ import annotations

from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sinks.base import AdaptedSink, Sink
from ..sinks.custom import CustomSink
from ..sinks.publish import Pending
from ..staging import stage, temporary_folders


def unwrapped(sink: Sink, sdf: DataFrame) -> tuple[Sink, DataFrame]:
    """The sink behind all adapters, and the rows as it gets them."""
    while isinstance(sink, AdaptedSink):
        sink, sdf = sink.inner, sink.transform(sdf)
    return sink, sdf


def _last_number(spark: SparkSession, table: str, batch_id: int) -> int | None:
    """The last number that the batch before has given; None for the first batch.

    Batches come one by one, so a missing number means that the table was lost, and numbers would be given twice.
    """
    if batch_id == 0:
        return None
    try:
        return spark.read.parquet(f"{table}/batch_id={batch_id - 1}").agg(F.max("last_number")).first()[0]
    except AnalysisException as exc:
        raise RuntimeError(f"the last number of batch {batch_id - 1} is not in {table}; numbers cannot go on") from exc


def prepare_batch(batch: DataFrame, sink: Sink, checkpoint: str, batch_id: int) -> Pending:
    """A micro-batch, written but not shown; numbers go on from those of the batch before."""
    sink, batch = unwrapped(sink, batch)
    if isinstance(sink, CustomSink):
        return sink.prepare(batch, batch_id)
    target, sequence = sink.batch_writer(batch_id), getattr(sink, "row_sequence", None)
    if sequence is None:
        return target.prepare(batch)
    spark, table = batch.sparkSession, f"{checkpoint}/last_number"
    last = _last_number(spark, table, batch_id)
    start = sequence.start if last is None else last + 1
    pending = target.prepare(batch, start=start)

    def publish() -> int:
        total = pending.publish()
        counted = spark.createDataFrame([(start + total - 1,)], "last_number bigint")
        counted.coalesce(1).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")
        return total

    return Pending(publish, pending.cancel)


def stream_sink(sdf: DataFrame, sink: Sink, checkpoint: str, name: str | None = None, **trigger: Any) -> StreamingQuery:
    """Write a stream to a sink and return the started query.

    A delimited sink writes each micro-batch to ``<path>/batch_id=<n>``. A batch that is repeated
    after a failure replaces its own folder and starts from the same number, so records and numbers
    come out once. The last number of each batch is kept under ``<checkpoint>/last_number``. A batch is
    evaluated once and leaves no intermediate table. A custom sink is written through its streaming writer.
    Adapters may stand in front of either.

    The default trigger is ``availableNow=True``: everything that is there, then the query ends.
    """
    sink, sdf = unwrapped(sink, sdf)
    writer = sdf.writeStream.option("checkpointLocation", f"{checkpoint}/query")
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    if name:
        writer = writer.queryName(name)
    if isinstance(sink, CustomSink):
        sdf.sparkSession.dataSource.register(sink.data_source(sdf.sparkSession))
        return writer.format(sink.name).outputMode("append").start()
    sequence = getattr(sink, "row_sequence", None)
    table = f"{checkpoint}/last_number"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        target = sink.batch_writer(batch_id)
        if sequence is None:
            target.write(batch)
            return
        spark = batch.sparkSession
        last = _last_number(spark, table, batch_id)
        start = sequence.start if last is None else last + 1
        with temporary_folders(spark):  # numbering reads its input twice, the batch itself is evaluated once
            total = target.write(stage(batch, "batch"), start=start)
        counted = spark.createDataFrame([(start + total - 1,)], "last_number bigint")
        counted.coalesce(1).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    return writer.foreachBatch(write_batch).start()
