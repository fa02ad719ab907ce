"""Functions of a money amount."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "amount_units", "trailing_nonzero_digits", "is_multiple", "is_round_amount", "lucky_digit_count",
    "lucky_digit_ratio", "amount_delta", "bool_double", "safe_number",
]


def bool_double(condition: Column) -> Column:
    """1.0 / 0.0 for true / false; an unknown condition stays null."""
    return condition.cast("double")


def amount_units(cents: Column) -> Column:
    """Cents to whole currency units, fraction cut off."""
    return (cents.cast("double") / F.lit(100.0)).cast("bigint")


def trailing_nonzero_digits(units: Column) -> Column:
    """Length of the run of non-zero digits at the right end: 500 -> 0, 123 -> 3, 105 -> 1."""
    return F.length(F.regexp_extract(units.cast("string"), "([1-9]*)$", 1))


def is_multiple(units: Column, n: int) -> Column:
    return bool_double((units % F.lit(n)) == 0)


def is_round_amount(units: Column) -> Column:
    """Large amount that is nearly a leading digit followed by zeros."""
    digits = F.length(units.cast("string"))
    lead = units.cast("double") / F.pow(F.lit(10.0), digits - 1)
    distance = F.abs(lead - F.round(lead))
    return bool_double((distance / digits < 0.01) & (units > 1000))


def lucky_digit_count(amount_text: Column) -> Column:
    """How many digits are 8 or 9."""
    return F.regexp_count(amount_text.cast("string"), F.lit("[89]")).cast("double")


def lucky_digit_ratio(amount_text: Column) -> Column:
    length = F.length(amount_text.cast("string"))
    return lucky_digit_count(amount_text) / F.nullif(length, F.lit(0))


def amount_delta(a: Column, b: Column) -> Column:
    return F.abs(a - b).cast("double")


def safe_number(value: Column, default: float = -1.0) -> Column:
    """Number in a text column; anything else, null included, becomes ``default``."""
    return F.coalesce(value.try_cast("double"), F.lit(default))
