"""Dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlake.functions.numeric import year_month
from bazaarlake.operators.skew import HotKeys, skew_join


def _with_centroid(
    df: DataFrame, geolocation: DataFrame, role: str, hot_zip: HotKeys
) -> DataFrame:
    zip_code = f"{role}_zip_code_prefix"
    centroids = geolocation.select(
        F.col("zip_code_prefix").alias(zip_code),
        F.col("latitude").alias(f"{role}_latitude"),
        F.col("longitude").alias(f"{role}_longitude"),
    )
    placed = skew_join(df, centroids, zip_code, hot_zip)
    return placed.select(*df.columns, f"{role}_latitude", f"{role}_longitude")


def dim_customers(customers: DataFrame, geolocation: DataFrame, hot_zip: HotKeys) -> DataFrame:
    return _with_centroid(customers, geolocation, "customer", hot_zip)


def dim_sellers(sellers: DataFrame, geolocation: DataFrame, hot_zip: HotKeys) -> DataFrame:
    return _with_centroid(sellers, geolocation, "seller", hot_zip)


def dim_products(products: DataFrame) -> DataFrame:
    volume = F.col("product_length_cm") * F.col("product_height_cm") * F.col("product_width_cm")
    return products.withColumn("product_volume_cm3", volume)


def dim_dates(orders: DataFrame) -> DataFrame:
    """Every day from the first purchase to the last promised delivery."""
    first, last = F.col("first_day"), F.col("last_day")
    span = orders.agg(
        F.to_date(F.min("order_purchase_timestamp")).alias("first_day"),
        F.to_date(F.max("order_estimated_delivery_date")).alias("last_day"),
    )
    # greatest() skips a NULL end and keeps the start day when the end is earlier.
    days = F.sequence(first, F.greatest(first, last), F.expr("INTERVAL 1 DAY"))
    day = F.col("day").cast("string")
    return span.select(F.explode(days).alias("day")).select(
        day.alias("date_day"),
        F.substring(day, 1, 4).alias("year"),
        F.substring(day, 6, 2).alias("month"),
        year_month(F.col("day")).alias("year_month"),
        (F.dayofweek("day") - 1).cast("string").alias("day_of_week"),
    )
