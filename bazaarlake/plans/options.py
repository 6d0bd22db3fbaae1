"""Values offered by the filter lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlake.operators.filters import ALL_YEARS
from bazaarlake.plans.grain import CATEGORY
from bazaarlake.plans.warehouse import Warehouse


def financial_years(wh: Warehouse) -> DataFrame:
    """'All Years', then 'Y-(Y+1)' for every calendar year with an order."""
    years = (
        wh.orders()
        .select(F.substring("purchase_month", 1, 4).cast("int").alias("year"))
        .filter(F.col("year").isNotNull())
        .distinct()
    )
    # The extra row comes out of the data's own aggregate: 0 sorts first.
    every = wh.orders().agg(F.lit(0).alias("year"))
    label = F.when(F.col("year") == 0, ALL_YEARS).otherwise(
        F.format_string("%04d-%d", F.col("year"), F.col("year") + 1)
    )
    return every.union(years).orderBy("year").select(label.alias("financial_year"))


def states(wh: Warehouse) -> DataFrame:
    buyers = wh.table("stg_customers").select(F.col("customer_state").alias("state")).distinct()
    sellers = wh.table("stg_sellers").select(F.col("seller_state").alias("state")).distinct()
    return buyers.union(sellers).filter("state IS NOT NULL").distinct().orderBy("state")


def categories(wh: Warehouse) -> DataFrame:
    return (
        wh.table("stg_products")
        .select(F.col(CATEGORY).alias("category"))
        .filter("category IS NOT NULL")
        .distinct()
        .orderBy("category")
    )


def payment_types(wh: Warehouse) -> DataFrame:
    return wh.table("fct_payments").select("payment_type").distinct().orderBy("payment_type")
