"""Streaming scans under the same contract as batch scans."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, types as T

from ..contracts import SourceContract
from ..operators.filters import apply_filters
from ..sources.reader import checked_records, load, reader_options, select_columns
from ..sources.rejects import tolerant_reader


def stream_source(
    spark: SparkSession,
    contract: SourceContract,
    path: str,
    fmt: str = "parquet",
    filters: Mapping[str, Any] | None = None,
    options: Mapping[str, str] | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """New files under ``path`` as a stream of the declared columns.

    The schema of the stored table is read once from the files that are there, unless it is given.
    A record that does not parse fails the query. Pass ``maxFilesPerTrigger`` in ``options`` to bound a micro-batch.
    """
    contract.bind_filters(filters)
    stored = schema or load(spark, contract, path, fmt, options).schema
    table = spark.readStream.format(fmt).schema(stored).options(**reader_options(fmt, options)).load(path)
    return select_columns(apply_filters(checked_records(table, fmt, options), contract, filters), contract)


def stream_unsplit(
    spark: SparkSession, contract: SourceContract, path: str, fmt: str = "parquet", options: Mapping[str, str] | None = None
) -> tuple[DataFrame, bool]:
    """The stored table as a stream that no record stops, and whether records that do not parse carry their raw text."""
    reader = tolerant_reader(spark.readStream, contract, fmt, options)
    if reader is not None:
        return reader.load(path), True
    stored = load(spark, contract, path, fmt, options).schema
    return spark.readStream.format(fmt).schema(stored).options(**reader_options(fmt, options)).load(path), False
