"""Lookups in optional maps, in JSON text and in maps with values of any type."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def map_get(col: Column | str, key: str) -> Column:
    """The value of a key in a map; NULL if the map is NULL or has no such key."""
    return F.element_at(_col(col), F.lit(key))


def json_get(col: Column | str, key: str) -> Column:
    """The same lookup on a JSON object held as text; the value comes back as text."""
    path = "$['" + key.replace("'", "\\'") + "']"
    return F.get_json_object(_col(col), path)


def _member(key: str) -> str:
    """The path of a key whatever characters it has, but for a quote together with a double quote."""
    if "'" not in key:
        return f"$['{key}']"
    if '"' in key:
        raise ValueError(f"a key with both kinds of quotes cannot be looked up: {key!r}")
    return f'$["{key}"]'


def any_map(col: Column | str) -> Column:
    """A JSON object held as text as a VARIANT: each value keeps its own type. Text that is no JSON is NULL."""
    return F.try_parse_json(_col(col))


def any_of(col: Column | str) -> Column:
    """A struct or a map with text keys as a VARIANT; members that are NULL are absent to a lookup."""
    return F.to_variant_object(_col(col))


def any_get(col: Column | str, key: str, kind: str) -> Column:
    """The value of a key in a VARIANT as type ``kind``; NULL if there is no such key, or its value is not of that type and cannot become it."""
    return F.try_variant_get(_col(col), _member(key), kind)


def any_kind(col: Column | str, key: str) -> Column:
    """The type that the value of a key has; NULL if there is no such key."""
    return F.schema_of_variant(F.try_variant_get(_col(col), _member(key), "variant"))


def json_map(col: Column | str) -> Column:
    """A JSON object held as text as a map of texts."""
    return F.from_json(_col(col), "map<string,string>")
