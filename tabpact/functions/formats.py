"""Formatting of values and cells as text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, functions as F

# Strftime codes and the datetime pattern letters with the same meaning.
STRFTIME_TO_PATTERN = {
    "Y": "yyyy",
    "y": "yy",
    "m": "MM",
    "d": "dd",
    "j": "DDD",
    "b": "MMM",
    "B": "MMMM",
    "a": "EEE",
    "A": "EEEE",
    "H": "HH",
    "M": "mm",
    "S": "ss",
    "F": "yyyy-MM-dd",
    "T": "HH:mm:ss",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strftime_pattern(pattern: str) -> str:
    """Translate a strftime pattern; an unknown code is refused rather than copied."""
    out: list[str] = []
    literal = ""
    chars = iter(pattern)

    def flush() -> None:
        nonlocal literal
        if literal:
            out.append("'" + literal.replace("'", "''") + "'")
            literal = ""

    for ch in chars:
        if ch != "%":
            literal += ch
            continue
        code = next(chars, "")
        if code == "%":
            literal += "%"
        elif code in STRFTIME_TO_PATTERN:
            flush()
            out.append(STRFTIME_TO_PATTERN[code])
        else:
            raise ValueError(f"unknown date code %{code} in {pattern!r}")
    flush()
    return "".join(out)


def fmt_date(col: Column | str, pattern: str = "%Y-%m-%d") -> Column:
    """A date or timestamp as text; NULL stays NULL."""
    if pattern in ("%Y-%m-%d", "%F"):
        return _col(col).cast("date").cast("string")  # the same text, without a formatter per row
    return F.date_format(_col(col), strftime_pattern(pattern))


def date_formatter(fmt: str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A formatter from a strftime pattern, or the given Column function."""
    if callable(fmt):
        return fmt
    strftime_pattern(fmt)  # refuse a bad pattern now
    return lambda c: fmt_date(c, fmt)


def fmt_none(col: Column | str, text: str = "") -> Column:
    """The value as text, with ``text`` for a NULL of any type."""
    return F.coalesce(_col(col).cast("string"), F.lit(text))


def python_formatter(fn: Callable[[object], str | None]) -> Callable[[Column], Column]:
    """A Column function from a plain Python function of one value; NULL is not passed to it.

    Values travel to Python in Arrow batches, which is still the slow path: prefer Column functions.
    """

    @F.arrow_udf("string")
    def apply(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else fn(v) for v in values.to_pylist()], pa.string())

    return apply


def quote_cell(col: Column | str, delimiter: str = ",", eol: str = "\n") -> Column:
    """RFC 4180: a cell that holds the delimiter, a quote or a line end is quoted, quotes doubled."""
    c = _col(col)
    marks = dict.fromkeys(('"', delimiter, "\n", "\r", eol))
    special = reduce(lambda a, b: a | b, (c.contains(mark) for mark in marks))
    return F.when(special, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
