"""Rounding, guarded ratios and date arithmetic as column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400.0


def as_double(column: Column, digits: int | None = None) -> Column:
    """Round exactly, then hand out a double."""
    return (column if digits is None else F.round(column, digits)).cast("double")


def rounded(column: Column, digits: int) -> Column:
    """Round a double half away from zero, as a double.

    Through a decimal, so that noise in the last binary digits cannot push an
    exact tie to the wrong side.
    """
    return F.round(column.cast("decimal(38,12)"), digits).cast("double")


def cents(name: str) -> Column:
    """Money as whole cents.

    Tables hold decimals; sums run on cents, which are exact too and several
    times cheaper: a decimal sum needs more digits than fit a machine word.
    """
    return (F.col(name) * 100).cast("bigint")


def money(total: Column) -> Column:
    """A total of cents as a double."""
    return (total.cast("decimal(36,0)") * F.lit(Decimal("0.01"))).cast("double")


def exact_sum(column: Column) -> Column:
    """Sum of whole numbers that may be larger than a machine word.

    High and low bits are summed apart, each as a plain word, and put together
    at the end: the low sum has room for 8 * 10^12 rows in a group.
    """
    high, low = F.shiftright(column, 20), column.bitwiseAND(F.lit(2**20 - 1))
    return F.sum(high).cast("decimal(20,0)") * F.lit(2**20) + F.sum(low).cast("decimal(20,0)")


def money_total(column: Column) -> Column:
    """Sum of cents as money, 0 for no rows."""
    return money(or_zero(exact_sum(column)))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double quotient; NULL when the denominator is 0 or NULL."""
    return F.when(denominator != 0, numerator.cast("double") / denominator.cast("double"))


def rounded_ratio(numerator: Column, denominator: Column, digits: int) -> Column:
    return rounded(ratio(numerator, denominator), digits)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """Share in percent, 0 for an empty whole."""
    share = part.cast("double") * F.lit(100.0) / whole.cast("double")
    return rounded(F.when(whole == 0, F.lit(0.0)).otherwise(share), digits)


def or_zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0))


def clamp01(column: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), column))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds between zone-less timestamps, free of the session zone."""
    gap = end - start
    return (
        F.extract(F.lit("DAY"), gap).cast("bigint") * 86400
        + F.extract(F.lit("HOUR"), gap).cast("bigint") * 3600
        + F.extract(F.lit("MINUTE"), gap).cast("bigint") * 60
        + F.extract(F.lit("SECOND"), gap).cast("bigint")
    )


def year_month(date: Column) -> Column:
    """'yyyy-MM' of a date."""
    return F.substring(date.cast("string"), 1, 7)


def month_number(key: Column) -> Column:
    """Running number of a 'yyyy-MM' month."""
    return F.substring(key, 1, 4).cast("int") * 12 + F.substring(key, 6, 2).cast("int")


def months_between_keys(start: Column, end: Column) -> Column:
    """Calendar months from one 'yyyy-MM' key to another."""
    return month_number(end) - month_number(start)


def number_value(column: Column, default: float = 0.0) -> Column:
    """A report cell as a number; NULL, '' and non-numbers give the default."""
    return F.coalesce(F.nullif(column.cast("string"), F.lit("")).try_cast("double"), F.lit(default))
