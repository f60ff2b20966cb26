"""Contracts: what a source delivers and what a sink accepts.

A contract is plain Python data. It holds no Column objects, so it can be declared at import time,
before a Spark session exists; expressions are SQL text or callables that build a Column on demand.
"""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, SparkSession, functions as F, types as T

from .errors import DefinitionError, raise_if

#: Marks a parameter without a default; ``None`` is a legal default.
REQUIRED: Any = type("_Required", (), {"__repr__": lambda self: "REQUIRED"})()


_PLAIN_TYPES = {
    t.simpleString(): t
    for t in (
        T.StringType(),
        T.BooleanType(),
        T.ShortType(),
        T.IntegerType(),
        T.LongType(),
        T.DoubleType(),
        T.DateType(),
        T.TimestampType(),
        T.TimestampNTZType(),
    )
}


def data_type(spec: str | T.DataType) -> T.DataType:
    """A DataType from itself or from a DDL type name such as ``decimal(12,2)``."""
    if isinstance(spec, T.DataType):
        return spec
    return _PLAIN_TYPES.get(spec) or T.DataType.fromDDL(spec)


def identifier_problem(kind: str, name: str) -> list[str]:
    """Names are identifiers; a parameter may be nested, its parts joined with dots."""
    parts = name.split(".") if kind == "parameter" else [name]
    return [] if all(part.isidentifier() for part in parts) else [f"{kind} name {name!r} is not an identifier"]


def duplicate_problems(kind: str, names: Iterable[str]) -> list[str]:
    seen: set[str] = set()
    problems = []
    for name in names:
        if name in seen:
            problems.append(f"{kind} {name!r} is declared twice")
        seen.add(name)
    return problems


@dataclass(frozen=True)
class Check:
    """A rule with an optional explanation.

    On data, ``expr`` is SQL text or a callable. A column check's callable gets the column, a row
    check's callable gets nothing. On a parameter, ``expr`` is a Python predicate over the value; on
    a contract's cross-parameter checks it is a predicate over the dict of all values. SQL text may stand
    for either; it names the parameters, of which it sees those with a Spark type.

    ``when_present`` makes the rule apply only where its input is there: a NULL outcome passes.
    """

    expr: str | Callable[..., Any]
    explain: str | None = None
    when_present: bool = False
    name: str | None = None

    def holds(self, value: Any, columns: Mapping[str, tuple[Any, T.DataType | None]]) -> bool:
        """Evaluate on a driver-side value; for SQL text, on a row of the parameters and their types."""
        if value is None and self.when_present:
            return True
        if not isinstance(self.expr, str):
            return bool(self.expr(value))
        outcome = _evaluate(self.expr, columns)
        return bool(outcome) or (outcome is None and self.when_present)

    def describe(self) -> str:
        return self.explain or self.name or (self.expr if isinstance(self.expr, str) else "check failed")


def _evaluate(text: str, columns: Mapping[str, tuple[Any, T.DataType | None]]) -> Any:
    """A SQL expression over typed parameters; Spark folds it to a constant, so no job runs."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise ValueError("a check in SQL needs a Spark session")
    row = [F.lit(value).cast(kind).alias(name) for name, (value, kind) in columns.items() if kind is not None]
    return spark.sql("SELECT 1").select(*row, F.lit(1)).select(F.expr(text)).first()[0]


def as_checks(checks: Check | str | Callable[..., Any] | Iterable[Any] | None) -> tuple[Check, ...]:
    """One check or a list of them; bare expressions are wrapped."""
    if checks is None:
        return ()
    if isinstance(checks, (Check, str)) or callable(checks):
        checks = [checks]
    return tuple(c if isinstance(c, Check) else Check(c) for c in checks)


@dataclass(frozen=True)
class ColumnSpec:
    """A declared column. A column is required unless ``nullable`` is set.

    ``source`` says how to compute it from the table read (SQL text or a callable returning a
    Column); by default the column of the same name is taken.
    """

    name: str
    type: str | T.DataType
    nullable: bool = False
    checks: Any = ()
    explain: str = ""
    source: str | Callable[[], Column] | None = None

    def __post_init__(self):
        object.__setattr__(self, "checks", as_checks(self.checks))

    @property
    def data_type(self) -> T.DataType:
        return data_type(self.type)

    def source_column(self) -> Column:
        if self.source is None:
            return F.col(self.name)
        return F.expr(self.source) if isinstance(self.source, str) else self.source()


@dataclass(frozen=True)
class Param:
    """A typed parameter with an optional default and checks on its value.

    ``type`` is a Spark type name for values that become literals, or ``None`` for any Python object
    (a list of names, a callable, a number generator).
    """

    name: str
    type: str | T.DataType | None
    default: Any = REQUIRED
    optional: bool = False
    checks: Any = ()
    explain: str = ""

    def __post_init__(self):
        object.__setattr__(self, "checks", as_checks(self.checks))

    def resolve(self, values: Mapping[str, Any]) -> tuple[Any, list[str]]:
        """The value to use and the problems with it."""
        value = values.get(self.name, self.default)
        if value is REQUIRED:
            return None, [f"{self.name!r} has neither a value nor a default"]
        if value is None and not self.optional:
            return None, [f"{self.name!r} must not be None"]
        if value is not None and self.type is not None:
            try:
                value = to_python(value, data_type(self.type))
            except (TypeError, ValueError, decimal.InvalidOperation) as exc:
                return None, [f"{self.name!r}: {exc}"]
        problems = []
        for check in self.checks:
            try:
                kind = None if self.type is None else data_type(self.type)
                passed = check.holds(value, {self.name: (value, kind)})
            except Exception as exc:  # a predicate that cannot judge the value has not passed it
                problems.append(f"{self.name!r}: {check.describe()} ({exc})")
                continue
            if not passed:
                problems.append(f"{self.name!r}: {check.describe()}")
        return value, problems


@dataclass(frozen=True)
class FilterParam(Param):
    """A parameter of the source query.

    ``predicate`` builds the condition from the typed literal. It is applied to the table as read,
    before columns are derived, so that it can reach the scan.
    """

    predicate: Callable[[Column], Column] | None = None

    def condition(self, value: Any) -> Column | None:
        """The conjunct to add, or None when an optional filter is not set."""
        if value is None or self.predicate is None:
            return None
        return self.predicate(F.lit(value).cast(data_type(self.type)))


def resolve_params(
    subject: str, params: Sequence[Param], checks: Sequence[Check], values: Mapping[str, Any], kind: str
) -> dict[str, Any]:
    """Type, default and check every parameter; raise once with everything that is wrong."""
    known = {p.name for p in params}
    problems = [f"unknown {kind} {name!r}" for name in values if name not in known]
    resolved: dict[str, Any] = {}
    for param in params:
        resolved[param.name], found = param.resolve(values)
        problems += found
    if not problems:
        for check in checks:
            try:
                columns = {p.name: (resolved[p.name], None if p.type is None else data_type(p.type)) for p in params}
                if not check.holds(resolved, columns):
                    problems.append(check.describe())
            except Exception as exc:
                problems.append(f"{check.describe()} ({exc})")
    raise_if(subject, problems)
    return resolved


@dataclass(frozen=True)
class SourceContract:
    """Named filters, typed columns, and rules over filters and over rows."""

    name: str
    columns: Sequence[ColumnSpec]
    filters: Sequence[FilterParam] = ()
    filter_checks: Any = ()
    column_checks: Any = ()
    explain: str = ""

    def __post_init__(self):
        object.__setattr__(self, "columns", tuple(self.columns))
        object.__setattr__(self, "filters", tuple(self.filters))
        object.__setattr__(self, "filter_checks", as_checks(self.filter_checks))
        object.__setattr__(self, "column_checks", as_checks(self.column_checks))
        problems = identifier_problem("source", self.name)
        for kind, items in (("column", self.columns), ("filter", self.filters)):
            for item in items:
                problems += identifier_problem(kind, item.name)
            problems += duplicate_problems(kind, (i.name for i in items))
        if not self.columns:
            problems.append("no columns are declared")
        raise_if(f"source {self.name!r}", problems)

    @property
    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    def schema(self) -> T.StructType:
        """The declared columns as a schema; ``explain`` becomes the field comment."""
        return T.StructType(
            [
                T.StructField(c.name, c.data_type, c.nullable, {"comment": c.explain} if c.explain else None)
                for c in self.columns
            ]
        )

    def bind_filters(self, values: Mapping[str, Any] | None = None) -> dict[str, Any]:
        """Typed filter values, checked one by one and together, before anything is read."""
        return resolve_params(
            f"source {self.name!r}", self.filters, self.filter_checks, values or {}, "filter"
        )


@dataclass(frozen=True)
class SinkContract:
    """Named typed parameters with defaults and rules, and rules over several of them."""

    name: str
    params: Sequence[Param]
    checks: Any = ()
    explain: str = ""

    def __post_init__(self):
        object.__setattr__(self, "params", tuple(self.params))
        object.__setattr__(self, "checks", as_checks(self.checks))
        problems = identifier_problem("sink", self.name)
        for param in self.params:
            problems += identifier_problem("parameter", param.name)
        problems += duplicate_problems("parameter", (p.name for p in self.params))
        raise_if(f"sink {self.name!r}", problems)

    def bind(self, **values: Any) -> dict[str, Any]:
        return resolve_params(f"sink {self.name!r}", self.params, self.checks, values, "parameter")


def to_python(value: Any, target: T.DataType) -> Any:
    """Convert a bound value to the Python form of its declared type, or refuse it."""
    name = target.simpleString()
    if isinstance(target, T.BooleanType):
        if isinstance(value, bool):
            return value
        raise TypeError(f"{value!r} is not a boolean")
    if isinstance(target, T.StringType):
        if isinstance(value, str):
            return value
        raise TypeError(f"{value!r} is not a text")
    if isinstance(target, T.DateType):
        if isinstance(value, dt.datetime):
            raise TypeError(f"{value!r} is not a date")
        return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)
    if isinstance(target, (T.TimestampType, T.TimestampNTZType)):
        return value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(value)
    if isinstance(value, bool):
        raise TypeError(f"{value!r} is not a {name}")
    if isinstance(target, T.IntegralType):
        number = int(value)
        if isinstance(value, (float, decimal.Decimal)) and number != value:
            raise ValueError(f"{value!r} is not a whole number")
        bits = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}[name]
        if not -(2 ** (bits - 1)) <= number < 2 ** (bits - 1):
            raise ValueError(f"{value!r} does not fit {name}")
        return number
    if isinstance(target, T.DecimalType):
        number = decimal.Decimal(str(value))
        if number.quantize(decimal.Decimal(1).scaleb(-target.scale)) != number:
            raise ValueError(f"{value!r} has more than {target.scale} decimals")
        if abs(number) >= decimal.Decimal(10) ** (target.precision - target.scale):
            raise ValueError(f"{value!r} does not fit {name}")
        return number
    if isinstance(target, (T.DoubleType, T.FloatType)):
        return float(value)
    return value


def flatten_params(values: Mapping[str, Any], prefix: str = "") -> dict[str, Any]:
    """Nested settings as dotted keys: ``{"a": {"b": 1}}`` becomes ``{"a.b": 1}``."""
    flat: dict[str, Any] = {}
    for key, value in values.items():
        path = f"{prefix}.{key}" if prefix else str(key)
        inner = flatten_params(value, path) if isinstance(value, Mapping) else {path: value}
        clash = flat.keys() & inner.keys()
        if clash:
            raise DefinitionError("parameters", [f"{name!r} is set twice" for name in sorted(clash)])
        flat.update(inner)
    return flat
