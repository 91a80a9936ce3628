"""Column expressions for numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NA_TOKENS

# Letters of number spellings that Java reads but flow files do not mean:
# hexadecimal floats and the type suffixes of "1.5f" or "2d".
_FOREIGN = "[xXdDfFpP]"
_INFINITY = r"(?i)^\s*[+-]?inf(inity)?\s*$"


def finite(c: Column) -> Column:
    """The value, or null when it is infinite or NaN (which sorts above infinity)."""
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def is_infinite(c: Column) -> Column:
    return F.abs(c) == F.lit(float("inf"))


def is_missing(c: Column) -> Column:
    """True for null and NaN, the two spellings of "no number"."""
    return c.isNull() | F.isnan(c)


def text_or_null(c: Column) -> Column:
    """Text with the "no value" tokens turned to null."""
    return F.when(c.isin(NA_TOKENS), None).otherwise(c)


def to_number(c: Column) -> Column:
    """Text to double; null for anything that is not fully a number.

    The "no value" tokens are not numbers, so they need no check of their own;
    "nan" becomes NaN.
    """
    return F.when(~c.rlike(_FOREIGN) | c.rlike(_INFINITY), c.try_cast("double"))


def to_finite_number(c: Column) -> Column:
    """As ``to_number``, but null for infinities and NaN."""
    number = c.try_cast("double")  # first of all, so that it is read once for both its uses
    return F.when((F.abs(number) < F.lit(float("inf"))) & ~c.rlike(_FOREIGN), number)


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, null for an empty whole."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return share(part, whole) * 100


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def round_probability(c: Column) -> Column:
    return F.round(c, 4)


def round_sample(c: Column) -> Column:
    return F.round(c, 6)
