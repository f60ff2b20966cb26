"""Column functions."""

from .formats import date_formatter, fmt_date, fmt_none, python_formatter, quote_cell, strftime_pattern
from .maps import any_get, any_kind, any_map, any_of, json_get, json_map, map_get
from .money import (
    MONEY_TYPE,
    cents_of_double,
    money,
    money_cent,
    money_cents,
    money_dollar,
    money_double,
    money_from_cents,
    money_from_double,
    money_is_valid,
)
from .predicates import anchor_end, date_range, exclude_when, length_of, matches, min_len

__all__ = [name for name in dir() if not name.startswith("_")]
