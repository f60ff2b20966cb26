"""Parameter filters of a source query."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame

from ..contracts import SourceContract
from ..errors import raise_if


def unanswered(contract: SourceContract, resolved: Mapping[str, Any]) -> list[str]:
    """Filters that have a value but no predicate: on a table nothing would come of them."""
    return [
        f"filter {p.name!r} has a value but no predicate to apply it with"
        for p in contract.filters
        if resolved.get(p.name) is not None and p.predicate is None
    ]


def apply_filters(df: DataFrame, contract: SourceContract, values: Mapping[str, Any] | None = None) -> DataFrame:
    """Keep the rows that satisfy every filter that is set.

    Values are typed, defaulted and checked first, so a wrong value raises before a job runs. An
    optional filter that is not set adds nothing to the plan. ``df`` is the table as read: filters
    are conjuncts on its own columns and so can be pushed into the scan.
    """
    resolved = contract.bind_filters(values)
    raise_if(f"source {contract.name!r}", unanswered(contract, resolved))
    for param in contract.filters:
        condition = param.condition(resolved[param.name])
        if condition is not None:
            df = df.where(condition)
    return df
