"""What every sink can do."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame

from ..operators.mapping import Field, as_field, map_record
from .publish import Pending


class Sink:
    """A target for the rows of a DataFrame. ``write`` is one job and leaves a closed output."""

    def write(self, df: DataFrame) -> Any:
        raise NotImplementedError

    def prepare(self, df: DataFrame, **how: Any) -> Pending:
        """Write all rows, but show nothing yet. A sink that does not know the two apart writes when it is published."""
        return Pending(lambda: self.write(df, **how))

    def check(self, df: DataFrame) -> None:
        """Raise a definition error if the rows do not fit; no job is run."""

    def batch_writer(self, batch_id: int) -> Sink:
        """The sink for one micro-batch. Writing the same batch again must replace its first output."""
        raise TypeError(f"{type(self).__name__} cannot take micro-batches")

    def adapt(self, mapping: Callable[[DataFrame], DataFrame] | Sequence[Field | tuple]) -> AdaptedSink:
        """A sink that maps every record before handing it to this one."""
        return AdaptedSink(self, mapping)


class AdaptedSink(Sink):
    """A record mapping in front of another sink."""

    def __init__(self, inner: Sink, mapping: Callable[[DataFrame], DataFrame] | Sequence[Field | tuple]):
        self.inner = inner
        self.mapping = mapping

    @property
    def fields(self) -> list[Field]:
        """The mapped fields, empty when the mapping is a function."""
        return [] if callable(self.mapping) else [as_field(f) for f in self.mapping]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.mapping(df) if callable(self.mapping) else map_record(df, self.fields)

    def check(self, df: DataFrame) -> None:
        self.inner.check(self.transform(df))

    def write(self, df: DataFrame, **how: Any) -> Any:
        return self.inner.write(self.transform(df), **how)

    def prepare(self, df: DataFrame, **how: Any) -> Pending:
        return self.inner.prepare(self.transform(df), **how)

    def batch_writer(self, batch_id: int) -> AdaptedSink:
        return AdaptedSink(self.inner.batch_writer(batch_id), self.mapping)
