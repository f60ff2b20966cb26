"""Names for columns that a job adds and removes again."""

from __future__ import annotations

from collections.abc import Iterable


def unused(name: str, columns: Iterable[str]) -> str:
    """``name``, or the first of it with underscores behind that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
