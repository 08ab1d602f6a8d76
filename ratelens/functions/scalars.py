"""Number, key and string expressions over single rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marker for a missing text field, and the text patterns of a review page.
MISSING = "NA"
FRACTION_PATTERN = r"([0-9]+/[0-9]+)"
LEADING_NUMBER_PATTERN = r"^([0-9.]+)"
NON_ASCII_PATTERN = r"[^\x00-\x7F]"
USER_INFO_SEPARATOR = " - "


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: Column | str) -> Column:
    """Text to double; anything that is not a number, NaN included, becomes NULL."""
    parsed = _col(c).try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def without_percent(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit("%"), F.lit(""))


def has_percent(c: Column | str) -> Column:
    return F.contains(_col(c), F.lit("%"))


def rating_out_of_ten(c: Column | str) -> Column:
    """Fraction in [0, 1], held as text, to a rating in [0, 10]."""
    return number(c) * F.lit(10.0)


def truncated(c: Column | str) -> Column:
    """Integer part, toward zero."""
    return _col(c).cast("int")


def null_if_missing(c: Column | str) -> Column:
    return F.nullif(_col(c), F.lit(MISSING))


def missing_as(c: Column | str, replacement: Column) -> Column:
    return F.when(_col(c) == F.lit(MISSING), replacement).otherwise(_col(c))


def fraction_value(c: Column | str) -> Column:
    """`a/b` as a double; NULL when either side is absent or b is zero."""
    parts = F.split(_col(c), "/")
    return F.try_divide(
        F.try_element_at(parts, F.lit(1)).try_cast("double"),
        F.try_element_at(parts, F.lit(2)).try_cast("double"),
    )


def fractions(c: Column | str) -> Column:
    """All `a/b` pieces of a text, in order."""
    return F.regexp_extract_all(_col(c), F.lit(FRACTION_PATTERN), F.lit(1))


def nth_fraction(c: Column | str, position: int) -> Column:
    """Value of the `position`-th fraction in a text, counted from 1."""
    return fraction_value(F.try_element_at(fractions(c), F.lit(position)))


def leading_number(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(c), LEADING_NUMBER_PATTERN, 1), F.lit("")).try_cast("double")


def ascii_only(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), NON_ASCII_PATTERN, "")


def user_info(c: Column | str, position: int) -> Column:
    """Part 1 (user), 2 (location) or 3 (date) of `user - location - date`."""
    return F.try_element_at(F.split(_col(c), USER_INFO_SEPARATOR), F.lit(position))


def review_key(item: Column | str, user_name: Column | str) -> Column:
    return F.concat_ws("_", _col(item), _col(user_name))


def significant(c: Column | str, digits: int = 5) -> Column:
    """Round to a number of significant digits."""
    value = _col(c)
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(value))))
    return F.when(value == 0, F.lit(0.0)).otherwise(F.round(value * scale) / scale)


def one_decimal(c: Column | str) -> Column:
    """Text with one digit after the point, halves rounded up."""
    return F.format_string("%.1f", _col(c))


def ordered_pair(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    return F.least(_col(a), _col(b)), F.greatest(_col(a), _col(b))


def linear_grid(start: float, stop: float, points: int) -> list[float]:
    """Evenly spaced parameter values, both ends included."""
    step = (stop - start) / (points - 1)
    return [start + step * i for i in range(points)]


def log_grid(start_exponent: float, stop_exponent: float, points: int) -> list[float]:
    """Powers of ten with evenly spaced exponents, both ends included."""
    return [10.0**e for e in linear_grid(start_exponent, stop_exponent, points)]
