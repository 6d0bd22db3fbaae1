"""The three analytics views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlake.functions.numeric import (
    SECONDS_PER_DAY,
    exact_sum,
    money,
    month_number,
    or_zero,
    ratio,
    rounded,
    rounded_ratio,
)
from bazaarlake.plans.grain import CATEGORY, mean_score, per_order, weighted, with_reviews
from bazaarlake.plans.warehouse import Warehouse

DELIVERED = "delivered"
CANCELED = "canceled"


def known_category() -> Column:
    return F.coalesce(CATEGORY, F.lit("unknown"))


def mean_days(seconds: Column, rows: Column) -> Column:
    """Mean delivery days from a total of seconds."""
    return F.when(rows > 0, (seconds.cast("double") / F.lit(SECONDS_PER_DAY)) / rows)


def revenue_by_category(wh: Warehouse, compat: bool = True) -> DataFrame:
    lines = wh.lines(category=True).withColumn("category", known_category())
    orders = with_reviews(per_order(wh, lines, "category", "is_late_delivery"), wh, compat=compat)
    rows = weighted("items")
    late = F.col("is_late_delivery")
    return (
        orders.groupBy("category")
        .agg(
            F.count("order_id").alias("orders"),
            F.sum(rows).alias("items_sold"),
            money(exact_sum(weighted("price"))).alias("merchandise_revenue"),
            money(exact_sum(weighted("freight"))).alias("freight_revenue"),
            money(exact_sum(weighted("gmv"))).alias("gmv"),
            rounded(mean_score(), 2).alias("avg_review_score"),
            rounded_ratio(
                F.sum(rows * late), F.sum(F.when(late.isNotNull(), rows)), 4
            ).alias("late_delivery_rate"),
        )
        .orderBy(F.desc("gmv"), "category")
    )


def delivery_sla_by_state(wh: Warehouse) -> DataFrame:
    lines = wh.lines(buyer=True, seller=("seller_state",)).filter(F.col("order_status") == DELIVERED)
    orders = per_order(
        wh, lines, "seller_state", "customer_state", "is_late_delivery", "delivery_seconds"
    )
    items, seconds = F.col("items"), F.col("delivery_seconds")
    return (
        orders.groupBy("seller_state", "customer_state")
        .agg(
            F.count("order_id").alias("orders"),
            rounded(
                mean_days(F.sum(items * seconds), F.sum(F.when(seconds.isNotNull(), items))), 2
            ).alias("avg_delivery_days"),
            rounded_ratio(F.sum(items * F.col("is_late_delivery")), F.sum(items), 4).alias(
                "late_delivery_rate"
            ),
            money(exact_sum(F.col("gmv"))).alias("gmv"),
        )
        .orderBy(F.desc("late_delivery_rate"), F.desc("orders"), "seller_state", "customer_state")
    )


def seller_performance_base(wh: Warehouse, compat: bool = True) -> DataFrame:
    """Sales, punctuality, reviews, cancellations and growth per seller.

    Order, then month, then seller: each step shrinks the rows before the next
    shuffle, and the first and last month fall out of the last one.
    """
    items = F.col("items")
    status, late = F.col("order_status"), F.col("is_late_delivery")
    orders = with_reviews(
        per_order(wh, wh.lines(), "seller_id", "order_status", "is_late_delivery", "purchase_month"), wh
    )
    monthly = orders.groupBy("seller_id", "purchase_month").agg(
        F.count("order_id").alias("orders"),
        F.sum("gmv").alias("gmv"),
        F.sum(items).alias("items"),
        F.sum(F.when(status == DELIVERED, items)).alias("delivered"),
        F.sum(F.when(status == DELIVERED, items * (1 - late))).alias("on_time"),
        F.sum(F.when(status == CANCELED, items).otherwise(0)).alias("canceled"),
        F.sum("score_sum").alias("score_sum"),
        F.sum("score_rows").alias("score_rows"),
    )
    # Lines without a month come before all others. A number as the order keeps
    # the aggregate on plain words, hence hashed rather than sorted.
    month = F.coalesce(month_number(F.col("purchase_month")), F.lit(-1))
    first, latest = F.min_by("gmv", month), F.max_by("gmv", month)
    growth = F.when(first > 0, ratio(latest - first, first)).otherwise(0.0)
    repeats = F.count(F.lit(1))
    named = F.col("seller_id").isNotNull()
    gmv = exact_sum(F.col("gmv"))
    sellers = monthly.groupBy("seller_id").agg(
        F.sum("orders").alias("orders"),
        # A line is repeated once per active month of its seller.
        (gmv * repeats if compat else gmv).alias("_gmv"),
        gmv.alias("_plain_gmv"),
        rounded_ratio(F.sum("on_time"), F.sum("delivered"), 4).alias("on_time_delivery_rate"),
        rounded(or_zero(mean_score()), 2).alias("avg_review_score"),
        rounded_ratio(F.sum("canceled"), F.sum("items"), 4).alias("cancellation_rate"),
        rounded(growth, 4).alias("revenue_growth_rate"),
    )
    places = wh.table("stg_sellers").select("seller_id", "seller_city", "seller_state")
    return sellers.join(places, "seller_id", "left").select(
        "seller_id",
        "seller_city",
        "seller_state",
        "orders",
        # Lines of no seller match neither reviews nor growth.
        money(F.when(named, F.col("_gmv")).otherwise(F.col("_plain_gmv"))).alias("gmv"),
        "on_time_delivery_rate",
        F.when(named, F.col("avg_review_score")).otherwise(0.0).alias("avg_review_score"),
        "cancellation_rate",
        F.when(named, F.col("revenue_growth_rate")).otherwise(0.0).alias("revenue_growth_rate"),
    )


def register_views(wh: Warehouse) -> None:
    """Session views under the usual names, re-evaluated on every read."""
    for name in ("fct_orders", "fct_order_items", "fct_payments"):
        wh.table(name).createOrReplaceTempView(name)
    revenue_by_category(wh).createOrReplaceTempView("vw_revenue_by_category")
    delivery_sla_by_state(wh).createOrReplaceTempView("vw_delivery_sla_by_state")
    seller_performance_base(wh).createOrReplaceTempView("vw_seller_performance_base")
