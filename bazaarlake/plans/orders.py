"""Order and product lookups, recent records, repeat orders, delivery estimate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlake.functions.numeric import exact_sum, money, rounded_ratio
from bazaarlake.operators.filters import bounded
from bazaarlake.plans.grain import per_order
from bazaarlake.plans.views import DELIVERED, known_category
from bazaarlake.plans.warehouse import Warehouse
from bazaarlake.sources.schemas import INGEST_SEQ


def orders_recent(wh: Warehouse, limit: int = 10) -> DataFrame:
    bounded("limit", limit, 1, 100)
    latest = F.desc_nulls_last("order_purchase_timestamp")
    return wh.table("fct_orders").orderBy(latest, "order_id").limit(limit)


def _last_entered(table: DataFrame, key: str, limit: int) -> DataFrame:
    bounded("limit", limit, 1, 100)
    return table.orderBy(F.desc(INGEST_SEQ), key).limit(limit).drop(INGEST_SEQ)


def products_recent(wh: Warehouse, limit: int = 10) -> DataFrame:
    return _last_entered(wh.table("dim_products"), "product_id", limit)


def sellers_recent(wh: Warehouse, limit: int = 10) -> DataFrame:
    return _last_entered(wh.table("dim_sellers"), "seller_id", limit)


def order_by_id(wh: Warehouse, order_id: str) -> DataFrame:
    """The order; no rows if it does not exist."""
    return wh.table("fct_orders").filter(F.col("order_id") == order_id)


def product_by_id(wh: Warehouse, product_id: str) -> DataFrame:
    return wh.table("dim_products").filter(F.col("product_id") == product_id).drop(INGEST_SEQ)


def repeat_orders_by_city(
    wh: Warehouse, city: str | None = None, limit: int = 20, min_repeat_orders: int = 2
) -> DataFrame:
    """Categories that people of a city ordered several times."""
    bounded("limit", limit, 1, 500)
    bounded("min_repeat_orders", min_repeat_orders, 2)
    lines = wh.lines(buyer=True, category=True).filter(
        (F.col("order_status") == DELIVERED) & F.col("customer_known")
    )
    if city is not None:
        lines = lines.filter(F.col("customer_city") == city.lower())
    lines = lines.withColumn("order_type", known_category())
    person_orders = per_order(wh, lines, "customer_city", "order_type", "customer_unique_id")
    people = (
        person_orders.groupBy("customer_city", "order_type", "customer_unique_id")
        .agg(F.count("order_id").alias("order_count"), F.sum("gmv").alias("gmv"))
        .filter(F.col("order_count") >= min_repeat_orders)
    )
    orders = F.sum("order_count")
    return (
        people.groupBy("customer_city", "order_type")
        .agg(
            F.count("customer_unique_id").alias("repeat_customers"),
            orders.alias("repeat_orders"),
            money(exact_sum(F.col("gmv"))).alias("gmv"),
            rounded_ratio(orders, F.count(F.lit(1)), 2).alias("avg_repeat_orders_per_customer"),
        )
        .orderBy(
            F.desc("repeat_orders"),
            F.desc("repeat_customers"),
            F.desc("gmv"),
            "customer_city",
            "order_type",
        )
        .limit(limit)
    )


def delivery_estimate(lanes: DataFrame, origin_zip: str | int, destination_zip: str | int) -> DataFrame:
    """Past performance of one lane; zip codes may be padded text.

    No rows if nothing was ever delivered on the lane.
    """
    origin, destination = int(origin_zip), int(destination_zip)
    return lanes.filter(
        (F.col("origin_zip") == origin) & (F.col("destination_zip") == destination)
    ).select(
        "origin_zip",
        "destination_zip",
        F.ceil("avg_delivery_days").alias("estimated_delivery_days"),
        "late_delivery_rate",
        F.col("orders").alias("historical_orders"),
        F.lit("exact historical lane").alias("method"),
    )
