"""Data-quality checks: every check counts offending rows, 0 passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlake.plans.warehouse import Warehouse

# Key columns that must be filled, keys that must be unique, and references
# that must resolve.
NOT_NULL = {
    "stg_orders": ["order_id", "customer_id"],
    "stg_customers": ["customer_id"],
    "fct_orders": ["order_id"],
    "fct_order_items": ["order_id"],
    "dim_products": ["product_id"],
}
UNIQUE = {
    "stg_orders": "order_id",
    "stg_customers": "customer_id",
    "fct_orders": "order_id",
    "dim_products": "product_id",
}
RELATIONSHIPS = {
    "orders_to_customers": ("fct_orders", "customer_id", "stg_customers"),
    "items_to_sellers": ("fct_order_items", "seller_id", "stg_sellers"),
}


class QualityError(RuntimeError):
    """Some checks failed; ``failures`` lists their names."""

    def __init__(self, failures: list[str]):
        super().__init__(f"quality checks failed: {', '.join(failures)}")
        self.failures = failures


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def repeated_rows(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first per key; rows without a key all count."""
    groups = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    extra = F.when(F.col(key).isNull(), F.col("rows")).otherwise(F.col("rows") - 1)
    return groups.agg(F.coalesce(F.sum(extra), F.lit(0)).alias("value"))


def orphan_rows(df: DataFrame, key: str, parents: DataFrame, nulls_count: bool) -> DataFrame:
    """Rows whose key has no parent.

    Keys are counted first: the anti-join meets each key once, however many
    rows share it.
    """
    counted = df if nulls_count else df.filter(F.col(key).isNotNull())
    keys = counted.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    orphans = keys.join(parents.select(key), key, "left_anti")
    return orphans.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("value"))


def orders_unique(wh: Warehouse) -> DataFrame:
    return repeated_rows(wh.table("stg_orders"), "order_id")


def customers_unique(wh: Warehouse) -> DataFrame:
    return repeated_rows(wh.table("stg_customers"), "customer_id")


def items_have_orders(wh: Warehouse) -> DataFrame:
    items, orders = wh.table("stg_order_items"), wh.table("stg_orders")
    return orphan_rows(items, "order_id", orders, nulls_count=True)


def orders_have_customers(wh: Warehouse) -> DataFrame:
    orders, customers = wh.table("stg_orders"), wh.table("stg_customers")
    return orphan_rows(orders, "customer_id", customers, nulls_count=True)


def payments_non_negative(wh: Warehouse) -> DataFrame:
    return (
        wh.table("stg_payments")
        .filter(F.col("payment_value") < 0)
        .agg(F.count(F.lit(1)).alias("value"))
    )


CHECKS = {
    "orders_have_unique_ids": orders_unique,
    "customers_have_unique_ids": customers_unique,
    "order_items_have_orders": items_have_orders,
    "orders_have_customers": orders_have_customers,
    "payments_are_non_negative": payments_non_negative,
}


def report(wh: Warehouse) -> DataFrame:
    """Check, offending rows and PASS or FAIL."""
    status = F.when(F.col("value") == 0, "PASS").otherwise("FAIL")
    return _union(
        [
            check(wh).select(F.lit(name).alias("check"), "value", status.alias("status"))
            for name, check in CHECKS.items()
        ]
    )


def enforce(checked: DataFrame) -> None:
    """Raise if a row of a report failed, after all checks have run."""
    failed = [row["check"] for row in checked.filter("status = 'FAIL'").collect()]
    if failed:
        raise QualityError(sorted(failed))


def not_null(wh: Warehouse) -> DataFrame:
    """Missing keys per table and column, one pass per table."""
    parts = []
    for table, columns in NOT_NULL.items():
        counts = wh.table(table).agg(
            *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns]
        )
        rows = F.array(
            *[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns]
        )
        parts.append(counts.select(F.lit(table).alias("table"), F.inline(rows)))
    return _union(parts)


def unique(wh: Warehouse) -> DataFrame:
    """Keys held by several rows."""
    parts = []
    for table, key in UNIQUE.items():
        groups = wh.table(table).filter(F.col(key).isNotNull()).groupBy(key)
        shared = groups.agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
        count = shared.agg(F.count(F.lit(1)).alias("duplicates"))
        parts.append(
            count.select(F.lit(table).alias("table"), F.lit(key).alias("column"), "duplicates")
        )
    return _union(parts)


def relationships(wh: Warehouse) -> DataFrame:
    """Filled references without a parent row."""
    parts = []
    for name, (table, key, parent) in RELATIONSHIPS.items():
        orphans = orphan_rows(wh.table(table), key, wh.table(parent), nulls_count=False)
        parts.append(
            orphans.select(F.lit(name).alias("relationship"), F.col("value").alias("orphans"))
        )
    return _union(parts)
