"""Fact tables, and the wide forms the queries start from.

``order_core``   one row per order, derived flags included
``order_heads``  order_core with the buyer's attributes
``order_lines``  items with everything of their order

The published facts are projections of the wide forms. Carrying the order and
buyer columns on the line spares every query the joins item-order-buyer, the
largest there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlake.functions.casts import MONEY
from bazaarlake.functions.numeric import SECONDS_PER_DAY, seconds_between, year_month
from bazaarlake.operators.skew import HotKeys, skew_join

# The published column names of orders and items.
TIMESTAMPS = [
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
]

FCT_ORDERS = [
    "order_id",
    "customer_id",
    "customer_unique_id",
    "order_status",
    "purchase_date",
    *TIMESTAMPS,
    "delivery_days",
    "is_late_delivery",
    "is_canceled",
]

FCT_ORDER_ITEMS = [
    "order_id",
    "order_item_id",
    "product_id",
    "seller_id",
    "shipping_limit_date",
    "price",
    "freight_value",
    "item_gmv",
    "purchase_date",
    "order_status",
    "is_late_delivery",
    "delivery_days",
]

# Order columns a line carries; the buyer's only where they are asked for.
LINE_ORDER_COLUMNS = [
    "customer_id",
    "order_status",
    "purchase_date",
    "order_purchase_timestamp",
    "purchase_month",
    "delivery_seconds",
    "delivery_days",
    "is_late_delivery",
]
BUYER_COLUMNS = [
    "customer_unique_id",
    "customer_city",
    "customer_state",
    "customer_zip_code_prefix",
    "customer_known",
]


def order_core(orders: DataFrame) -> DataFrame:
    bought = F.col("order_purchase_timestamp")
    arrived = F.col("order_delivered_customer_date")
    purchase_date = F.to_date(bought)
    # Seconds stay whole numbers so that their sums are exact.
    seconds = seconds_between(bought, arrived)
    late = arrived > F.col("order_estimated_delivery_date")
    return orders.select(
        "order_id",
        "customer_id",
        "order_status",
        purchase_date.alias("purchase_date"),
        *TIMESTAMPS,
        seconds.alias("delivery_seconds"),
        (seconds / F.lit(SECONDS_PER_DAY)).alias("delivery_days"),
        F.when(late, 1).otherwise(0).alias("is_late_delivery"),
        F.when(F.col("order_status") == "canceled", 1).otherwise(0).alias("is_canceled"),
        year_month(purchase_date).alias("purchase_month"),
    )


def buyers(customers: DataFrame) -> DataFrame:
    return customers.select(
        "customer_id",
        "customer_unique_id",
        "customer_city",
        "customer_state",
        "customer_zip_code_prefix",
        F.lit(True).alias("customer_known"),
    )


def order_heads(core: DataFrame, customers: DataFrame, hot_customer: HotKeys) -> DataFrame:
    heads = skew_join(core, buyers(customers), "customer_id", hot_customer, order_sized=True)
    return heads.select(*core.columns, *BUYER_COLUMNS)


def line_gmv() -> Column:
    return (F.col("price") + F.col("freight_value")).cast(MONEY)


def order_lines(items: DataFrame, heads: DataFrame, hot_order: HotKeys) -> DataFrame:
    """Items with their order's columns; ``heads`` may be core or heads."""
    carried = [c for c in LINE_ORDER_COLUMNS + BUYER_COLUMNS if c in heads.columns]
    head = heads.select("order_id", *carried, F.lit(True).alias("order_known"))
    lines = skew_join(items, head, "order_id", hot_order, order_sized=True)
    return lines.select(*items.columns, line_gmv().alias("item_gmv"), *carried, "order_known")


def fct_payments(payments: DataFrame) -> DataFrame:
    return payments.select(
        "order_id",
        "payment_sequential",
        "payment_type",
        "payment_installments",
        "payment_value",
    )


def fct_orders_warehouse_variant(orders: DataFrame) -> DataFrame:
    """Order fact without buyer columns, delivery in whole elapsed days."""
    bought = F.col("order_purchase_timestamp")
    arrived = F.col("order_delivered_customer_date")
    promised = F.col("order_estimated_delivery_date")
    return orders.select(
        "order_id",
        "customer_id",
        "order_status",
        F.to_date(bought).alias("purchase_date"),
        "order_purchase_timestamp",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
        F.extract(F.lit("DAY"), arrived - bought).cast("int").alias("delivery_days"),
        F.when(arrived > promised, 1).otherwise(0).alias("is_late_delivery"),
    )
