"""Record mapping: project a source's columns to the named fields of an output."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Field:
    """An output field.

    ``expr`` is SQL text (a plain column name included) or a callable returning a Column. ``uses``
    names the source columns it reads and ``via`` the function it goes through; both are for lineage
    only. A field that is a plain column name uses that column.
    """

    name: str
    expr: object
    uses: tuple[str, ...] | None = None
    via: str | None = None

    def column(self) -> Column:
        if isinstance(self.expr, Column):
            return self.expr
        if isinstance(self.expr, str):
            return F.expr(self.expr)
        return self.expr()

    def inputs(self) -> tuple[str, ...]:
        if self.uses is not None:
            return tuple(self.uses)
        plain = isinstance(self.expr, str) and self.expr.isidentifier()
        return (self.expr,) if plain else ()


def as_field(field: Field | tuple) -> Field:
    return field if isinstance(field, Field) else Field(*field)


def map_record(df: DataFrame, fields: Sequence[Field | tuple]) -> DataFrame:
    """Project to the output fields, in order; NULL stays NULL. Names may hold any character."""
    return df.select(*[as_field(f).column().alias(as_field(f).name) for f in fields])
