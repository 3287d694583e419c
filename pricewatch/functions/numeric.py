"""Number handling: missing values, safe floats, half-even rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(value: Column) -> Column:
    """NaN means "missing" in the price domain; Spark would rank it above all numbers."""
    return F.when(~F.isnan(value), value)


#: Plain decimal numbers; a cast alone would also take Java's suffixes and hexadecimal floats.
PLAIN_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_double(value: Column) -> Column:
    """Double of a number, or of text that is a plain decimal number, else null."""
    text = value.cast("string")
    plain = F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))
    # the type is known when the plan is made, so only one branch stays in it
    return F.when(F.typeof(value) == "string", plain).otherwise(value.try_cast("double"))


def safe_double(value: Column, fallback: float = 0.0) -> Column:
    """Double value; null, NaN, infinity or text that is no plain number become ``fallback``."""
    number = to_double(value)
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    return F.when(finite, number).otherwise(F.lit(fallback))


def is_finite(value: Column) -> Column:
    """False for NaN and infinities; null stays null."""
    return ~F.isnan(value) & (F.abs(value) < float("inf"))


def half_even(value: Column, digits: int = 0) -> Column:
    """Half-even rounding on the decimal text of the double (0.5 -> 0, 2.5 -> 2)."""
    return F.bround(value, digits)


def zero_to_null(value: Column) -> Column:
    return F.when(value != 0, value)


def clip_negative(value: Column) -> Column:
    """Forecast floor at zero; null stays null."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))
