"""Cells and lines of text from typed rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.formats import fmt_date, fmt_none, quote_cell

Formatter = Callable[[Column], Column]

QUOTING = ("rfc4180", "raw")


def quoted_name(name: str) -> str:
    """A column name as a reference that survives dots, blanks and back-ticks."""
    return "`" + name.replace("`", "``") + "`"


def default_formatters() -> dict[str, Formatter]:
    """One formatter per type name; a type that is not listed is cast to text."""
    return {"date": fmt_date, "map": F.to_json, "array": F.to_json, "struct": F.to_json}


def format_cells(
    df: DataFrame, formatters: Mapping[str, Formatter] | None = None, none_text: str | Formatter | None = ""
) -> DataFrame:
    """Every column as text by the formatter of its type.

    ``formatters`` overrides the defaults by type name (``date``, ``decimal``, ``bigint``, ..).
    ``none_text`` replaces NULL: a text, a Column function, or None to keep NULL.
    """
    table = {**default_formatters(), **(formatters or {})}
    cells = []
    for field in df.schema.fields:
        col = F.col(quoted_name(field.name))
        formatter = table.get(field.dataType.typeName(), lambda c: c.cast("string"))
        cell = formatter(col)
        if callable(none_text):
            cell = F.when(col.isNull(), none_text(col)).otherwise(cell.cast("string"))
        elif none_text is not None:
            cell = fmt_none(cell, none_text)
        cells.append(cell.alias(field.name))
    return df.select(*cells)


def render_line(
    df: DataFrame, delimiter: str = ",", none_text: str = "", quoting: str = "rfc4180", eol: str = "\n"
) -> Column:
    """The line of a row whose columns are texts. NULL becomes ``none_text`` before the join."""
    if quoting not in QUOTING:
        raise ValueError(f"quoting must be one of {QUOTING}, not {quoting!r}")
    cells = []
    for field in df.schema.fields:
        cell = fmt_none(quoted_name(field.name), none_text)
        cells.append(quote_cell(cell, delimiter, eol) if quoting == "rfc4180" else cell)
    if len(cells) == 1 and quoting == "rfc4180":  # a blank line would be read as no record
        return F.when(cells[0] == "", F.lit('""')).otherwise(cells[0])
    return F.concat_ws(delimiter, *cells)


def render_rows(
    df: DataFrame, delimiter: str = ",", none_text: str = "", quoting: str = "rfc4180", eol: str = "\n"
) -> DataFrame:
    """One text column ``line``: the cells of each row joined with the delimiter."""
    text = df if all(isinstance(f.dataType, T.StringType) for f in df.schema.fields) else format_cells(df, none_text=None)
    return text.select(render_line(text, delimiter, none_text, quoting, eol).alias("line"))
