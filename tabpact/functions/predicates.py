"""Predicates for filters and checks, all of them plain Column expressions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def date_range(col: Column | str, lo: Any = None, hi: Any = None) -> Column:
    """``lo <= col < hi``; an end that is None is open. The upper end is not included.

    Give the ends in the column's own type so that the bare column is compared and the condition
    reaches the scan.
    """
    c = _col(col)
    parts = []
    if lo is not None:
        parts.append(c >= lo)
    if hi is not None:
        parts.append(c < hi)
    if not parts:
        return F.lit(True)
    return parts[0] if len(parts) == 1 else parts[0] & parts[1]


def exclude_when(condition: Column, flag: Column | bool | None) -> Column:
    """Drop rows for which ``condition`` is true if ``flag`` is true, otherwise keep all rows.

    A row whose condition is NULL is kept. A condition that is never NULL (``isNotNull``,
    ``eqNullSafe``) can be pushed into the scan.
    """
    if flag is None:
        return F.lit(True)
    switch = F.lit(flag) if isinstance(flag, bool) else flag
    return F.coalesce(~switch, F.lit(True)) | ~condition | condition.isNull()


def anchor_end(pattern: str) -> str:
    r"""The pattern with every ``$`` anchor written as ``\z``.

    Java's ``$`` also matches in front of a final line end, which would let ``'SID123456\n'`` pass.
    A ``$`` that is escaped or stands in a character class or in ``\Q..\E`` is not an anchor.
    """
    out: list[str] = []
    depth = i = 0
    while i < len(pattern):
        ch = pattern[i]
        if pattern.startswith(r"\Q", i):
            end = pattern.find(r"\E", i)
            end = len(pattern) if end < 0 else end + 2
            out.append(pattern[i:end])
            i = end
            continue
        if ch == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if ch == "[":
            depth += 1
        elif ch == "]" and depth:
            depth -= 1
        out.append(r"\z" if ch == "$" and not depth else ch)
        i += 1
    return "".join(out)


def matches(col: Column | str, pattern: str, unicode_classes: bool = False) -> Column:
    r"""True where the pattern is found anywhere in the text.

    ``$`` means the very end of the text, ``.`` is any character but a newline. ``\d`` and ``\w`` are
    ASCII unless ``unicode_classes`` is set.
    """
    flags = "(?dU)" if unicode_classes else "(?d)"
    return _col(col).rlike(flags + anchor_end(pattern))


def length_of(col: Column | str, unit: str = "bytes") -> Column:
    """Length in UTF-8 ``bytes``, in ``chars``, or in ``items`` of an array or map."""
    measures = {"bytes": F.octet_length, "chars": F.char_length, "items": F.size}
    if unit not in measures:
        raise ValueError(f"unit must be one of {sorted(measures)}, not {unit!r}")
    c = _col(col)
    # size(NULL) is not NULL in every mode, so ask first.
    return F.when(c.isNotNull(), F.size(c)) if unit == "items" else measures[unit](c)


def min_len(col: Column | str, n: int, unit: str = "bytes") -> Column:
    """True where the value is at least ``n`` long, NULL where it is missing."""
    return length_of(col, unit) >= n
