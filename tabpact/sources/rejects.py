"""Per-record failures: bad records go to a second frame, the others continue."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any, TypeVar

from pyspark.sql import DataFrame, DataFrameReader, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamReader

from ..contracts import SourceContract, data_type
from ..operators.filters import apply_filters
from .reader import TEXT_FORMATS, load, raw_schema, select_columns, whole_records

CORRUPT = "_corrupt_record"
R = TypeVar("R", DataFrameReader, DataStreamReader)


def split_rejects(df: DataFrame, targets: Mapping[str, str | T.DataType]) -> tuple[DataFrame, DataFrame]:
    """Convert columns to their target types; rows with a value that cannot be converted are rejected.

    The good frame has the converted columns. The rejects keep their raw values and name the columns
    that failed in ``reject_columns``. A NULL is not a failure.
    """
    types = {name: data_type(spec) for name, spec in targets.items()}
    failed = {n: F.col(n).isNotNull() & F.col(n).try_cast(t).isNull() for n, t in types.items()}
    if not failed:
        return df, df.where(F.lit(False)).withColumn("reject_columns", F.array().cast("array<string>"))
    any_failed = reduce(lambda a, b: a | b, failed.values())
    good = df.where(~any_failed).withColumns({n: F.col(n).try_cast(t) for n, t in types.items()})
    names = F.array_compact(F.array(*[F.when(cond, F.lit(n)) for n, cond in failed.items()]))
    return good, df.where(any_failed).withColumn("reject_columns", names)


def split_records(table: DataFrame, contract: SourceContract, tolerant: bool) -> tuple[DataFrame, DataFrame]:
    """A table as read, batch or stream, as rows that parse and rejects.

    ``tolerant`` says that it was read with :func:`tolerant_reader`, so that rejects carry their raw text.
    """
    if not tolerant:
        return split_rejects(table, {c.name: c.data_type for c in contract.columns if c.source is None})
    parsed = whole_records([c for c in table.columns if c != CORRUPT])
    return table.where(F.col(CORRUPT).isNull() & parsed).drop(CORRUPT), table.where(F.col(CORRUPT).isNotNull() & parsed)


def tolerant_reader(reader: R, contract: SourceContract, fmt: str, options: Mapping[str, str] | None) -> R | None:
    """A batch or stream reader that keeps the text of records that do not parse; None where a format has no such text."""
    schema = raw_schema(contract) if fmt in TEXT_FORMATS else None
    if schema is None:
        return None
    schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    settings = {**(options or {}), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return reader.format(fmt).schema(schema).options(**settings)


def read_with_rejects(
    spark: SparkSession,
    contract: SourceContract,
    path: str,
    fmt: str = "csv",
    options: Mapping[str, str] | None = None,
    filters: Mapping[str, Any] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Read a table so that records which do not parse do not stop the job.

    CSV and JSON rejects hold the parsed columns and the raw text in ``_corrupt_record``. Other
    formats are read as stored and split by converting to the declared types. Filters apply to the
    records that parse; a reject has no values that they could be applied to.
    """
    contract.bind_filters(filters)
    reader = tolerant_reader(spark.read, contract, fmt, options)
    table = load(spark, contract, path, fmt, options) if reader is None else reader.load(path)
    good, rejects = split_records(table, contract, reader is not None)
    return select_columns(apply_filters(good, contract, filters), contract), rejects
