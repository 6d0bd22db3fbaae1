"""Lenient casts for text columns: a value that does not parse becomes NULL.

Columns that already carry a type (parquet sources) pass through the same
functions unharmed, so staging has one code path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = "decimal(18,2)"
# Degrees as decimals, so that centroid sums do not depend on row order.
DEGREES = "decimal(20,15)"


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def text(df: DataFrame, name: str) -> Column:
    """The column with '' read as NULL, if it is text."""
    return F.nullif(F.col(name), F.lit("")) if is_text(df, name) else F.col(name)


def to_int(df: DataFrame, name: str) -> Column:
    # Through double, because '40.7' has to become 40.
    return text(df, name).try_cast("double").try_cast("int").alias(name)


def to_money(df: DataFrame, name: str) -> Column:
    return text(df, name).try_cast(MONEY).alias(name)


def to_double(df: DataFrame, name: str) -> Column:
    return text(df, name).try_cast("double").alias(name)


def to_degrees(df: DataFrame, name: str) -> Column:
    return text(df, name).try_cast(DEGREES).alias(name)


def to_timestamp(df: DataFrame, name: str) -> Column:
    """Zone-less timestamp with fractions of a second dropped."""
    column = text(df, name)
    if is_text(df, name):
        column = F.regexp_replace(column, r"(:\d{2})\.\d+", "$1")
    return column.try_cast("timestamp_ntz").alias(name)
