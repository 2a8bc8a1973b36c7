"""Scalar rules shared by all operators: rounding, clamping, safe casts, text forms of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is stripped from text fields.
BLANK = " \t\n\x0b\f\r"


def exact_round(x: Column, digits: int = 2) -> Column:
    """Correct rounding of the binary value, as a double (round() works on the decimal form and differs on ties).

    What is not finite has no digits and stays as it is.
    """
    return F.coalesce(F.replace(F.format_number(x, digits), F.lit(","), F.lit("")).try_cast("double"), x)


def snap_round(x: Column) -> Column:
    """Two places by way of six, so that a mean that should lie on a half cent rounds alike however it was summed."""
    return exact_round(exact_round(x, 6), 2)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def safe_double(x: Column) -> Column:
    return F.btrim(x.cast("string"), F.lit(BLANK)).try_cast("double")


def finite(x: Column) -> Column:
    return x.isNotNull() & (F.abs(x) < F.lit(float("inf")))


def missing_if_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def _formatted(x: Column, digits: int) -> Column:
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(F.format_number(x, digits))


def money(x: Column, digits: int = 2) -> Column:
    """1,234.50; inf, -inf and nan by name"""
    return _formatted(x, digits)


def plain(x: Column, digits: int = 2) -> Column:
    """1234.50; inf, -inf and nan by name"""
    return F.replace(_formatted(x, digits), F.lit(","), F.lit(""))


def number_text(x: Column) -> Column:
    """The shortest digits of a double, without an exponent from 1e-4 up to 1e16: 10000000.0 where a cast gives 1.0E7."""
    text, size = x.cast("string"), F.abs(x)
    long = F.regexp_replace(text.cast("decimal(38,20)").cast("string"), r"(\.[0-9]+?)0+$", "$1")
    return F.when(((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3)), long).otherwise(text)


def upper_strip(x: Column) -> Column:
    return F.upper(F.btrim(x, F.lit(BLANK)))


def tickers(csv: Column) -> Column:
    """Comma-separated text -> array of upper-case symbols, blanks dropped, repeats kept."""
    return F.filter(F.transform(F.split(csv, ","), upper_strip), lambda t: t != "")


def truthy_text(x: Column) -> Column:
    """x, or null where a text is empty; "0" stays."""
    return F.when(x != "", x)
