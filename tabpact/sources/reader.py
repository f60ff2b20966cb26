"""Reading a table under a contract."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..contracts import SourceContract
from ..errors import raise_if
from ..operators.filters import apply_filters

#: Formats that carry no types of their own.
TEXT_FORMATS = ("csv", "json")


def select_columns(df: DataFrame, contract: SourceContract) -> DataFrame:
    """Only the declared columns, in declared order and type."""
    present = set(df.columns)
    raise_if(
        f"source {contract.name!r}",
        [f"column {c.name!r} is missing" for c in contract.columns if c.source is None and c.name not in present],
    )
    return df.select(
        *[
            c.source_column().cast(c.data_type).alias(c.name, metadata={"comment": c.explain} if c.explain else {})
            for c in contract.columns
        ]
    )


def raw_schema(contract: SourceContract) -> T.StructType | None:
    """The file schema for a text format: the declared columns, unless some are computed."""
    if any(c.source is not None for c in contract.columns):
        return None
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in contract.schema()])


def reader_options(fmt: str, options: Mapping[str, str] | None) -> dict[str, str]:
    return ({"mode": "FAILFAST"} if fmt in TEXT_FORMATS else {}) | dict(options or {})


def whole_records(names: Sequence[str]) -> Column:
    """Always true, but it needs every column: a reader that skips one does not notice that it is broken."""
    return reduce(lambda a, b: a + b, (F.col(n).isNull().cast("int") for n in names)) >= 0


def checked_records(table: DataFrame, fmt: str, options: Mapping[str, str] | None) -> DataFrame:
    """A table of a text format, batch or stream, read so that a record is parsed whole whatever columns are asked for."""
    failfast = reader_options(fmt, options).get("mode", "").upper() == "FAILFAST"
    return table.where(whole_records(table.columns)) if fmt in TEXT_FORMATS and failfast and table.columns else table


def load(
    spark: SparkSession,
    contract: SourceContract,
    path: str,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """The table as stored. ``fmt="table"`` takes ``path`` as a catalog name.

    A record of a text format that does not parse fails the job, unless the options give another mode:
    as NULLs it would lose its values and pass. See :func:`tabpact.read_with_rejects`.
    """
    if fmt == "table":
        return spark.table(path)
    reader = spark.read.format(fmt).options(**reader_options(fmt, options))
    schema = raw_schema(contract) if fmt in TEXT_FORMATS else None
    return checked_records((reader.schema(schema) if schema else reader).load(path), fmt, options)


def read_source(
    spark: SparkSession,
    contract: SourceContract,
    path: str,
    fmt: str = "parquet",
    filters: Mapping[str, Any] | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Filter the stored table by the contract's parameters and project the declared columns."""
    contract.bind_filters(filters)
    table = load(spark, contract, path, fmt, options)
    return select_columns(apply_filters(table, contract, filters), contract)


# Decimal digits that hold every value of a whole-number type.
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}


def widens(have: T.DataType, want: T.DataType) -> bool:
    """Whether a cast from one type to the other keeps every value."""
    if have == want:
        return True
    if isinstance(want, T.StringType):
        return isinstance(have, (T.StringType, T.CharType, T.VarcharType))
    whole = list(_DIGITS)
    if type(have) in _DIGITS:
        if type(want) in _DIGITS:
            return whole.index(type(have)) <= whole.index(type(want))
        if isinstance(want, T.DecimalType):
            return want.precision - want.scale >= _DIGITS[type(have)]
        return isinstance(want, T.DoubleType) and not isinstance(have, T.LongType)
    if isinstance(have, T.FloatType):
        return isinstance(want, T.DoubleType)
    if isinstance(have, T.DecimalType) and isinstance(want, T.DecimalType):
        return want.scale >= have.scale and want.precision - want.scale >= have.precision - have.scale
    return isinstance(have, T.DateType) and isinstance(want, T.TimestampNTZType)


def conform(df: DataFrame, contract: SourceContract, strict_nulls: bool = False) -> DataFrame:
    """Check a frame against a contract and return its declared columns.

    One error lists every missing column and every type that would lose values; with
    ``strict_nulls`` also every nullable column that is declared required. Files never promise that
    a column is free of NULLs, so by default that is left to the required-value check.
    """
    fields = {f.name: f for f in df.schema.fields}
    problems = []
    for spec in contract.columns:
        field = fields.get(spec.name)
        if field is None:
            problems.append(f"column {spec.name!r} is missing")
            continue
        if not widens(field.dataType, spec.data_type):
            problems.append(
                f"column {spec.name!r} is {field.dataType.simpleString()}, declared {spec.data_type.simpleString()}"
            )
        if strict_nulls and field.nullable and not spec.nullable:
            problems.append(f"column {spec.name!r} may be null, declared required")
    raise_if(f"source {contract.name!r}", problems)
    return df.select(*[F.col(c.name).cast(c.data_type).alias(c.name) for c in contract.columns])
