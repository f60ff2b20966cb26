"""Amounts of money as DECIMAL(12,2): a dollar part that fits an unsigned 32-bit number and cents."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

MONEY_TYPE = "decimal(12,2)"
MAX_DOLLAR = 4294967295  # largest unsigned 32-bit number
_MAX_CENTS = MAX_DOLLAR * 100 + 99


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money_is_valid(dollar: Column | str, cent: Column | str) -> Column:
    """True where the parts make an amount: 0 <= dollar <= 4294967295 and 0 <= cent < 100."""
    return _col(dollar).between(0, MAX_DOLLAR) & _col(cent).between(0, 99)


def money(dollar: Column | str, cent: Column | str) -> Column:
    """The amount, NULL where the parts do not make one."""
    cents = _col(dollar).cast("bigint") * 100 + _col(cent).cast("bigint")
    return F.when(money_is_valid(dollar, cent), money_from_cents(cents))


def money_from_cents(cents: Column | str) -> Column:
    """The amount for a whole number of cents, NULL if it is negative or too large."""
    c = _col(cents)
    in_range = c.between(0, _MAX_CENTS)
    return F.when(in_range, (c.cast("decimal(12,0)") * F.lit(Decimal("0.01"))).cast(MONEY_TYPE))


def cents_of_double(x: Column | str) -> Column:
    """Whole cents of a double, rounded half away from zero; NULL for NaN and out-of-range values."""
    scaled = F.round(_col(x) * 100)
    return F.when(scaled.between(-9.0e15, 9.0e15), scaled.cast("bigint"))


def money_from_double(x: Column | str) -> Column:
    """The amount nearest to a double, NULL where it is negative, NaN or too large."""
    return money_from_cents(cents_of_double(x))


def money_cents(m: Column | str) -> Column:
    """The whole amount in cents."""
    return (_col(m) * 100).cast("bigint")


def money_dollar(m: Column | str) -> Column:
    return F.floor(_col(m)).cast("bigint")


def money_cent(m: Column | str) -> Column:
    return (money_cents(m) % 100).cast("smallint")


def money_double(m: Column | str) -> Column:
    """dollar + cent / 100 as a double."""
    return money_dollar(m).cast("double") + money_cent(m).cast("double") / 100
