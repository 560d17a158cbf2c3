"""Arithmetic that gives null where a result would be meaningless."""

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def finite(x: Column) -> Column:
    """True unless x is null, NaN or infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def finite_or_null(x: Column) -> Column:
    return F.when(finite(x), x)


def divide(x: Column, y: Column, least: float = TINY) -> Column:
    """x / y; null unless both are finite and |y| > least."""
    return F.when(finite(x) & finite(y) & (F.abs(y) > least), F.try_divide(x, y))


def subtract(x: Column, y: Column) -> Column:
    """x - y; null unless both are finite."""
    return F.when(finite(x) & finite(y), x - y)


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def zero_filled(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def number(text: Column) -> Column:
    """A number given as a number or as text; null if it is neither."""
    return text.try_cast("double")


def percent_encoded(text: Column) -> Column:
    """Each byte but A-Z a-z 0-9 - _ . ~ as %XX, so that a space is %20."""
    coded = F.url_encode(text)
    for made, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(made), F.lit(wanted))
    return coded
