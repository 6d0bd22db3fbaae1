"""Dashboard measures. None of them repeats a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlake.functions.numeric import (
    cents,
    exact_sum,
    money,
    money_total,
    months_between_keys,
    rounded,
    rounded_ratio,
    year_month,
)
from bazaarlake.operators.filters import bounded
from bazaarlake.operators.skew import skew_join
from bazaarlake.plans.features import cohort_retention
from bazaarlake.plans.grain import per_order
from bazaarlake.plans.sales import sales_summary
from bazaarlake.plans.views import DELIVERED, delivery_sla_by_state, known_category
from bazaarlake.plans.warehouse import Warehouse


def _gmv() -> Column:
    return money_total(cents("item_gmv")).alias("gmv")


def measures(wh: Warehouse) -> DataFrame:
    items = wh.lines(order=False)
    gmv = items.agg(money_total(cents("item_gmv")).alias("total_gmv"))
    sellers = (
        wh.table("stg_order_items")
        .select("seller_id")
        .distinct()
        .agg(F.count("seller_id").alias("active_sellers"))
    )
    orders = wh.orders().agg(
        F.count(F.when(F.col("order_status") == DELIVERED, 1)).alias("delivered_orders"),
        rounded_ratio(F.sum("is_late_delivery"), F.count(F.lit(1)), 4).alias("late_delivery_rate"),
    )
    reviews = wh.table("stg_reviews").agg(
        rounded_ratio(F.sum("review_score"), F.count("review_score"), 2).alias("avg_review_score")
    )
    one_row = gmv
    for part in (orders, sellers, reviews):
        one_row = one_row.crossJoin(F.broadcast(part))
    return one_row.select(
        "total_gmv", "delivered_orders", "active_sellers", "avg_review_score", "late_delivery_rate"
    )


def gmv_by_city(wh: Warehouse) -> DataFrame:
    return wh.lines(buyer=True).groupBy("customer_city").agg(_gmv())


def orders_by_city(wh: Warehouse) -> DataFrame:
    return wh.orders(buyer=True).groupBy("customer_city").agg(F.count("order_id").alias("orders"))


def _top(df: DataFrame, key: str, limit: int) -> DataFrame:
    bounded("limit", limit, 1)
    return df.orderBy(F.desc("gmv"), key).limit(limit)


def top_cities(wh: Warehouse, limit: int = 10) -> DataFrame:
    return _top(gmv_by_city(wh), "customer_city", limit)


def top_states(wh: Warehouse, limit: int = 10) -> DataFrame:
    sales = wh.lines(buyer=True).groupBy("customer_state").agg(_gmv())
    return _top(sales, "customer_state", limit)


def top_sellers_by_gmv(wh: Warehouse, limit: int = 10) -> DataFrame:
    places = wh.table("stg_sellers").select("seller_id", "seller_city", "seller_state")
    sales = wh.lines(order=False).filter("seller_id IS NOT NULL").groupBy("seller_id").agg(_gmv())
    # Only the winners are looked up.
    top = _top(sales, "seller_id", limit).join(places, "seller_id", "left")
    named = top.select("seller_id", "seller_city", "seller_state", "gmv")
    return named.orderBy(F.desc("gmv"), "seller_id")


def monthly_gmv_growth(wh: Warehouse) -> DataFrame:
    """GMV per month and its change on the calendar month before."""
    months = (
        wh.lines()
        .filter("purchase_month IS NOT NULL")
        .groupBy(F.col("purchase_month").alias("month"))
        .agg(exact_sum(cents("item_gmv")).alias("total"))
    )
    # One row per calendar month, so one task sorts a few hundred rows at most.
    by_month = Window.orderBy("month")
    adjacent = months_between_keys(F.lag("month").over(by_month), F.col("month")) == 1
    prior = F.when(adjacent, F.lag("total").over(by_month))
    growth = rounded_ratio((F.col("total") - F.col("prior")) * 100, F.col("prior"), 2)
    return (
        months.withColumn("prior", prior)
        .select(
            "month",
            money(F.col("total")).alias("gmv"),
            money(F.col("prior")).alias("prior_month_gmv"),
            growth.alias("growth_pct"),
        )
        .orderBy("month")
    )


def _late_rate(orders: DataFrame, key: str) -> DataFrame:
    """Late orders among a group's orders; rows hold one order per group."""
    late = F.sum("is_late_delivery")
    return orders.groupBy(key).agg(
        F.count("is_late_delivery").alias("orders"),
        rounded_ratio(late, F.count("is_late_delivery"), 4).alias("late_delivery_rate"),
    )


def late_rate_by_seller_state(wh: Warehouse) -> DataFrame:
    lines = wh.lines(seller=("seller_state",))
    return _late_rate(per_order(wh, lines, "seller_state", "is_late_delivery"), "seller_state")


def late_rate_by_category(wh: Warehouse) -> DataFrame:
    lines = wh.lines(category=True).withColumn("category", known_category())
    return _late_rate(per_order(wh, lines, "category", "is_late_delivery"), "category")


def state_lanes(wh: Warehouse) -> DataFrame:
    """State pairs by volume."""
    return (
        delivery_sla_by_state(wh)
        .drop("gmv")
        .orderBy(F.desc("orders"), "seller_state", "customer_state")
    )


def distance_vs_days(lanes: DataFrame) -> DataFrame:
    """Scatter points: one per lane with a known distance."""
    return lanes.filter("avg_distance_km IS NOT NULL").select(
        "origin_zip", "destination_zip", "avg_distance_km", "avg_delivery_days", "orders"
    )


def cohort_heatmap(wh: Warehouse) -> DataFrame:
    """Retention matrix with one column for every month the orders span."""
    # One row back to the driver: the width of the matrix.
    span = wh.orders().agg(
        months_between_keys(F.min("purchase_month"), F.max("purchase_month")).alias("months")
    ).first()["months"]
    columns = list(range((span or 0) + 1))
    matrix = (
        cohort_retention(wh)
        .groupBy("cohort_month")
        .pivot("month_number", columns)
        .agg(F.first("retention_rate"))
    )
    named = [F.col(f"`{n}`").alias(f"month_{n}") for n in columns]
    return matrix.select("cohort_month", *named).orderBy("cohort_month")


def rfm_distribution(rfm: DataFrame) -> DataFrame:
    # Money back to cents, so that the total does not depend on row order.
    spend = exact_sum(F.round(F.col("monetary") * 100).cast("bigint"))
    return rfm.groupBy("rfm_segment").agg(
        F.count(F.lit(1)).alias("customers"), money(spend).alias("monetary")
    )


def monetary_by_state_category(wh: Warehouse) -> DataFrame:
    """Delivered sales by buyer's state and category."""
    lines = wh.lines(buyer=True, category=True).filter(F.col("order_status") == DELIVERED)
    return lines.groupBy("customer_state", known_category().alias("category")).agg(
        money_total(cents("item_gmv")).alias("monetary")
    )


def _momentum(wh: Warehouse, lines: DataFrame, key: Column, name: str) -> DataFrame:
    """Sales of the latest month against the month before.

    The two months are a table of two rows that lines meet by equality, so a
    stored warehouse reads the files of these months only.
    """
    latest = F.to_date(F.concat(F.max("purchase_month"), F.lit("-01")))
    ages = F.array(*(F.struct(F.lit(n).alias("age"), F.add_months("_day", -n).alias("day")) for n in (0, 1)))
    two = wh.orders().agg(latest.alias("_day")).select(F.inline(ages))
    months = two.select("age", year_month(F.col("day")).alias("purchase_month"))
    # The condition always holds; with one Spark takes the trouble to prune files by this table.
    months = months.where("purchase_month > ''")
    recent = lines.join(F.broadcast(months), "purchase_month")
    age = F.col("age")
    now = exact_sum(F.when(age == 0, cents("item_gmv")).otherwise(0))
    before = exact_sum(F.when(age == 1, cents("item_gmv")).otherwise(0))
    return recent.groupBy(key.alias(name)).agg(
        money(now).alias("latest_gmv"),
        money(before).alias("previous_gmv"),
        money(now - before).alias("gmv_change"),
        rounded_ratio((now - before) * 100, before, 2).alias("change_pct"),
    )


def city_momentum(wh: Warehouse) -> DataFrame:
    return _momentum(wh, wh.lines(buyer=True), F.col("customer_city"), "customer_city")


def category_momentum(wh: Warehouse) -> DataFrame:
    return _momentum(wh, wh.lines(category=True), known_category(), "category")


def seller_momentum(wh: Warehouse) -> DataFrame:
    return _momentum(wh, wh.lines(), F.col("seller_id"), "seller_id")


def before_latest_month(wh: Warehouse) -> Warehouse:
    """The warehouse as it was before the orders of the latest month came in."""
    month = F.substring(F.col("order_purchase_timestamp").cast("string"), 1, 7)
    orders = wh.raw["orders"].withColumn("_month", month)
    latest = orders.agg(F.max("_month").alias("_latest"))
    # One row.
    earlier = orders.crossJoin(F.broadcast(latest)).filter("_month < _latest")
    kept = earlier.select("order_id")
    raw = {**wh.raw, "orders": earlier.drop("_month", "_latest")}
    for dataset in ("order_items", "order_payments", "order_reviews"):
        raw[dataset] = skew_join(
            wh.raw[dataset], kept, "order_id", wh.hot("order_id"), "left_semi", order_sized=True
        )
    return Warehouse(raw=raw, skew=wh.skew)


def ingest_impact(before: Warehouse, after: Warehouse, compat: bool = True) -> DataFrame:
    """Headline figures of two states of the data, one row per figure.

    Two stored versions do as well: ``open_warehouse(store, 0)`` and
    ``open_warehouse(store)``.
    """

    def figures(wh: Warehouse, state: str) -> DataFrame:
        summary = sales_summary(wh, compat=compat)
        pairs = [
            F.struct(F.lit(name).alias("measure"), F.col(name).cast("double").alias(state))
            for name in summary.columns
        ]
        return summary.select(F.inline(F.array(*pairs)))

    change = rounded(F.col("after") - F.col("before"), 4)
    return (
        figures(before, "before")
        .join(figures(after, "after"), "measure")
        .select("measure", "before", "after", change.alias("change"))
    )

