"""The four feature reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarlake.functions.bands import rfm_segment, risk_tier
from bazaarlake.functions.geo import haversine_km
from bazaarlake.functions.numeric import (
    clamp01,
    money_total,
    months_between_keys,
    or_zero,
    rounded,
    rounded_ratio,
)
from bazaarlake.plans.grain import per_order
from bazaarlake.plans.views import DELIVERED, mean_days, seller_performance_base
from bazaarlake.plans.warehouse import Warehouse

# Weights of the seller score, in percent of 100.
ON_TIME_WEIGHT, REVIEW_WEIGHT, CANCEL_WEIGHT, GROWTH_WEIGHT = 0.4, 0.3, 0.2, 0.1
BEST_REVIEW = 5


def seller_scores(wh: Warehouse, compat: bool = True) -> DataFrame:
    base = seller_performance_base(wh, compat)
    on_time = F.lit(ON_TIME_WEIGHT) * or_zero(F.col("on_time_delivery_rate"))
    review = F.lit(REVIEW_WEIGHT) * (or_zero(F.col("avg_review_score")) / BEST_REVIEW)
    kept = F.lit(CANCEL_WEIGHT) * (1 - or_zero(F.col("cancellation_rate")))
    growth = F.lit(GROWTH_WEIGHT) * clamp01((or_zero(F.col("revenue_growth_rate")) + 1) / 2)
    score = rounded(F.lit(100.0) * (on_time + review + kept + growth), 2)
    return base.withColumn("performance_score", score).withColumn(
        "risk_tier", risk_tier(F.col("performance_score"))
    )


def customer_rfm(wh: Warehouse) -> DataFrame:
    """Recency, frequency and spend per person over delivered orders with items.

    Orders of buyers that are not known are those of one person, NULL.
    """
    lines = wh.lines(buyer=True).filter(
        (F.col("order_status") == DELIVERED) & F.col("purchase_date").isNotNull()
    )
    orders = per_order(wh, lines, "customer_unique_id", "purchase_date")
    people = orders.groupBy("customer_unique_id").agg(
        F.max("purchase_date").alias("last_purchase"),
        F.count("order_id").alias("frequency"),
        money_total(F.col("gmv")).alias("monetary"),
    )
    today = wh.orders().agg(F.max("purchase_date").alias("analysis_date"))
    recency = F.date_diff("analysis_date", "last_purchase")
    # One row: safe to broadcast whatever the size of the orders.
    return people.crossJoin(F.broadcast(today)).select(
        "customer_unique_id",
        recency.alias("recency_days"),
        "frequency",
        "monetary",
        rfm_segment(recency, F.col("frequency"), F.col("monetary")).alias("rfm_segment"),
    )


def cohort_retention(wh: Warehouse) -> DataFrame:
    """Persons of each first-purchase month that bought again n months later.

    Buyers that are not known are one person, NULL.
    """
    months = (
        wh.orders(buyer=True)
        .filter(
            (F.col("order_status") == DELIVERED) & F.col("purchase_month").isNotNull()
        )
        .select("customer_unique_id", F.col("purchase_month").alias("order_month"))
        .distinct()
    )
    # After distinct() a person has at most one row per calendar month.
    person = Window.partitionBy("customer_unique_id")
    active = months.withColumn("cohort_month", F.min("order_month").over(person))
    counts = (
        active.withColumn(
            "month_number", months_between_keys(F.col("cohort_month"), F.col("order_month"))
        )
        .groupBy("cohort_month", "month_number")
        .agg(F.count(F.lit(1)).alias("customers"))
    )
    # Everyone of a cohort is active in month 0.
    cohort = Window.partitionBy("cohort_month")
    size = F.max(F.when(F.col("month_number") == 0, F.col("customers"))).over(cohort)
    return (
        counts.withColumn("cohort_size", size)
        .withColumn("retention_rate", rounded_ratio(F.col("customers"), F.col("cohort_size"), 4))
        .select("cohort_month", "month_number", "customers", "cohort_size", "retention_rate")
        .orderBy("cohort_month", "month_number")
    )


def delivery_lanes(wh: Warehouse, compat: bool = True) -> DataFrame:
    """Delivered lines per pair of seller and customer zip code.

    Coordinates belong to zip codes, so the distance is worked out once per
    lane, not once per line.
    """
    lines = wh.lines(buyer=True, seller=("seller_zip_code_prefix",)).filter(
        (F.col("order_status") == DELIVERED) & F.col("seller_known") & F.col("customer_known")
    )
    lanes = lines.groupBy(
        F.col("seller_zip_code_prefix").alias("origin_zip"),
        F.col("customer_zip_code_prefix").alias("destination_zip"),
    ).agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("delivery_seconds").alias("seconds"),
        F.count("delivery_seconds").alias("timed"),
        F.sum("is_late_delivery").alias("late"),
    )
    orders = F.col("orders")
    days = mean_days(or_zero(F.col("seconds")), orders if compat else F.col("timed"))

    def corner(end: str) -> DataFrame:
        return wh.table("stg_geolocation").select(
            F.col("zip_code_prefix").alias(f"{end}_zip"),
            F.col("latitude").alias(f"{end}_lat"),
            F.col("longitude").alias(f"{end}_lng"),
        )

    distance = haversine_km(
        F.col("origin_lat"), F.col("origin_lng"), F.col("destination_lat"), F.col("destination_lng")
    )
    return (
        lanes.join(corner("origin"), "origin_zip", "left")
        .join(corner("destination"), "destination_zip", "left")
        .select(
            "origin_zip",
            "destination_zip",
            "orders",
            rounded(days, 2).alias("avg_delivery_days"),
            rounded_ratio(F.col("late"), orders, 4).alias("late_delivery_rate"),
            rounded(distance, 2).alias("avg_distance_km"),
        )
    )
