"""Filtered sales figures and the headline insights.

``compat=True`` gives the figures of the plain star join, in which a line is
repeated once per review (and per payment) of its order. ``compat=False``
counts every line and payment once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlake.functions.numeric import (
    cents,
    exact_sum,
    money,
    money_total,
    or_zero,
    percent,
    ratio,
    rounded,
)
from bazaarlake.operators.filters import NO_FILTER, SalesFilter, bounded
from bazaarlake.plans.grain import (
    CATEGORY,
    filtered_lines,
    filtered_orders,
    mean_score,
    paid_with,
    per_order,
    reviewed_with,
    weighted,
    with_reviews,
)
from bazaarlake.plans.views import DELIVERED, known_category, mean_days
from bazaarlake.plans.warehouse import Warehouse


def _score() -> Column:
    return rounded(or_zero(mean_score()), 2)


def _known(condition: Column) -> Column:
    """Count of rows of existing orders meeting a condition."""
    return F.count(F.when(F.col("order_known") & condition, 1))


def _late_share() -> Column:
    """Late orders in percent, over rows holding one order each."""
    return percent(_known(F.col("is_late_delivery") == 1), _known(F.lit(True)))


def _order_rows(
    wh: Warehouse,
    lines: DataFrame,
    flt: SalesFilter,
    compat: bool,
    *keys: str,
    known_orders_only: bool = False,
) -> DataFrame:
    """Line sums per order and keys, under the payment and review conditions."""
    orders = paid_with(per_order(wh, lines, *keys), wh, flt.payment_type)
    return with_reviews(orders, wh, flt.review_score, compat, known_orders_only)


def sales_summary(
    wh: Warehouse, flt: SalesFilter = NO_FILTER, compat: bool = True
) -> DataFrame:
    """Headline figures from one read of the lines: a row per order and seller, of which one stands for the
    order; buyers and sellers are then grouped side by side, so neither is counted by copying all rows."""
    rows = _order_rows(
        wh,
        filtered_lines(wh, flt),
        flt,
        compat,
        "seller_id",
        "order_status",
        "is_late_delivery",
        "customer_id",
        "order_known",
    )
    in_order = Window.partitionBy("order_id").orderBy("seller_id")
    once = F.row_number().over(in_order) == 1
    delivered = F.col("order_status") == DELIVERED
    late, known = F.col("is_late_delivery") == 1, F.col("order_known")
    gmv, priced = weighted("gmv"), weighted("priced")
    totals = {
        # High and low bits apart, as a total may be larger than a machine word.
        "gmv_high": F.shiftright(gmv, 20),
        "gmv_low": gmv.bitwiseAND(F.lit(2**20 - 1)),
        # A mean over lines leaves out lines without a price.
        "units": priced if compat else (F.col("once") & known).cast("bigint"),
        "score_sum": F.col("score_sum"),
        "score_rows": F.col("score_rows"),
        "delivered_orders": (F.col("once") & delivered).cast("bigint"),
        "known_orders": (F.col("once") & known).cast("bigint"),
        "late_orders": (F.col("once") & known & late).cast("bigint"),
    }
    parties = (
        rows.withColumn("once", once)
        .withColumns({"buyer": F.when(delivered, F.col("customer_id")), "seller": F.when(delivered, F.col("seller_id"))})
        .groupingSets([["buyer"], ["seller"]], "buyer", "seller")
        .agg(F.grouping("seller").alias("of_buyers"), *(F.sum(c).alias(n) for n, c in totals.items()))
    )
    # Every figure but the number of sellers is taken from the buyers' groups.
    ours = F.col("of_buyers") == 1

    def total(name: str) -> Column:
        return F.sum(F.when(ours, F.col(name)))

    high, low = (total(n).cast("decimal(20,0)") for n in ("gmv_high", "gmv_low"))
    sums = parties.agg(
        (high * F.lit(2**20) + low).alias("gmv"),
        *(total(n).alias(n) for n in ("units", "score_sum", "score_rows")),
        *(or_zero(total(n)).alias(n) for n in ("delivered_orders", "known_orders", "late_orders")),
        F.count(F.when(ours, F.col("buyer"))).alias("active_customers"),
        F.count(F.when(~ours, F.col("seller"))).alias("active_sellers"),
    )
    score = F.when(F.col("score_rows") > 0, F.col("score_sum").cast("double") / F.col("score_rows"))
    return sums.select(
        money(or_zero(F.col("gmv"))).alias("total_gmv"),
        "delivered_orders",
        "active_sellers",
        "active_customers",
        rounded(or_zero(ratio(F.col("gmv"), F.col("units") * 100)), 2).alias("avg_order_value"),
        rounded(or_zero(score), 2).alias("avg_review_score"),
        percent(F.col("late_orders"), F.col("known_orders")).alias("late_delivery_rate"),
    )


def sales_map(
    wh: Warehouse, flt: SalesFilter = NO_FILTER, limit: int = 200, compat: bool = True
) -> DataFrame:
    """Sales by buyer's city and category; without compat by city, with its
    best-selling category."""
    bounded("limit", limit, 1, 500)
    lines = filtered_lines(wh, flt, buyer=True, category=True)
    place = ["customer_city", "customer_state"]
    if not compat:
        lines = lines.withColumn(CATEGORY, known_category())
    orders = _order_rows(
        wh, lines, flt, compat, *place, CATEGORY, "is_late_delivery", "order_known"
    )
    shown_place = [F.coalesce(place[0], F.lit("unknown")), F.coalesce(place[1], F.lit("unknown"))]
    if compat:
        groups = orders.groupBy(*place, CATEGORY).agg(
            _known(F.lit(True)).alias("orders"),
            money_total(weighted("gmv")).alias("gmv"),
            _score().alias("avg_review_score"),
            _late_share().alias("late_delivery_pct"),
        )
        top_category = known_category()
    else:
        # The rows of an order already share a task; one of them stands for it.
        in_order = Window.partitionBy("order_id").orderBy(CATEGORY)
        once = F.row_number().over(in_order) == 1
        per_category = (
            orders.withColumn("known", (F.col("order_known") & once).cast("int"))
            .withColumn("late", F.col("known") * F.col("is_late_delivery"))
            .groupBy(*place, CATEGORY)
            .agg(*[F.sum(c).alias(c) for c in ("known", "late", "gmv", "score_sum", "score_rows")])
        )
        best_first = F.struct(-or_zero(F.col("gmv")), F.col(CATEGORY))
        groups = per_category.groupBy(*place).agg(
            or_zero(F.sum("known")).alias("orders"),
            money_total(F.col("gmv")).alias("gmv"),
            _score().alias("avg_review_score"),
            percent(or_zero(F.sum("late")), or_zero(F.sum("known"))).alias("late_delivery_pct"),
            F.min_by(CATEGORY, best_first).alias("top_category"),
        )
        top_category = F.col("top_category")
    ties = place + [CATEGORY] if compat else place
    return (
        groups.orderBy(F.desc("gmv"), *ties)
        .limit(limit)
        .select(
            shown_place[0].alias("city"),
            shown_place[1].alias("state"),
            "orders",
            "gmv",
            "avg_review_score",
            "late_delivery_pct",
            top_category.alias("top_category"),
        )
    )


def sales_categories(
    wh: Warehouse, flt: SalesFilter = NO_FILTER, limit: int = 10, compat: bool = True
) -> DataFrame:
    bounded("limit", limit, 1, 20)
    lines = filtered_lines(wh, flt, category=True)
    if not compat:
        lines = lines.withColumn(CATEGORY, known_category())
    return (
        _order_rows(wh, lines, flt, compat, CATEGORY)
        .groupBy(CATEGORY)
        .agg(
            money_total(weighted("gmv")).alias("gmv"),
            F.count("order_id").alias("orders"),
            _score().alias("avg_review_score"),
        )
        .orderBy(F.desc("gmv"), CATEGORY)
        .limit(limit)
        .select(known_category().alias("category"), "gmv", "orders", "avg_review_score")
    )


def _plain_sales(wh: Warehouse, flt: SalesFilter, lines: DataFrame, *keys: str) -> DataFrame:
    """GMV per keys with every line counted once.

    Without payment or review conditions nothing has to be grouped by order.
    """
    if flt.payment_type or flt.review_score:
        lines = per_order(wh, lines, *keys)
        lines = reviewed_with(paid_with(lines, wh, flt.payment_type), wh, flt.review_score)
        return lines.groupBy(*keys).agg(money_total(F.col("gmv")).alias("gmv"))
    return lines.groupBy(*keys).agg(money_total(cents("item_gmv")).alias("gmv"))


def sales_trend(wh: Warehouse, flt: SalesFilter = NO_FILTER, compat: bool = True) -> DataFrame:
    lines = filtered_lines(wh, flt)
    if compat:
        orders = _order_rows(wh, lines, flt, compat, "purchase_month")
        months = orders.groupBy("purchase_month").agg(money_total(weighted("gmv")).alias("gmv"))
    else:
        months = _plain_sales(wh, flt, lines, "purchase_month")
    return months.select(F.col("purchase_month").alias("month"), "gmv").orderBy("month")


def _payment_totals(wh: Warehouse, flt: SalesFilter, compat: bool) -> DataFrame:
    payments = wh.table("fct_payments")
    if flt.payment_type:
        payments = payments.filter(F.col("payment_type") == flt.payment_type)
    totals = payments.groupBy("order_id", "payment_type").agg(
        F.count(F.lit(1)).alias("payments"), F.sum(cents("payment_value")).alias("value")
    )
    conditions = flt.order_conditions()
    if not compat:
        if conditions:
            totals = totals.join(
                filtered_orders(wh, flt).select("order_id").hint("merge"), "order_id", "left_semi"
            )
        if flt.on_items:
            matching = filtered_lines(wh, SalesFilter(
                seller_state=flt.seller_state, product_category=flt.product_category
            ))
            matching = matching.select("order_id").distinct().hint("merge")
            totals = totals.join(matching, "order_id", "left_semi")
        totals = reviewed_with(totals, wh, flt.review_score)
        times = F.lit(1)
    else:
        # Each payment is repeated once per line and review of its order.
        needs_order = bool(conditions or flt.on_items or flt.review_score)
        orders = filtered_orders(wh, flt).select("order_id", F.lit(True).alias("known"))
        items = wh.table("stg_order_items")
        if flt.on_items:
            items = filtered_lines(wh, SalesFilter(
                seller_state=flt.seller_state, product_category=flt.product_category
            ))
        lines = items.groupBy("order_id").agg(F.count(F.lit(1)).alias("lines"))
        reviews = wh.table("stg_reviews")
        if flt.review_score:
            reviews = reviews.filter(F.col("review_score") == flt.review_score)
        reviews = reviews.groupBy("order_id").agg(F.count(F.lit(1)).alias("reviews"))
        totals = (
            totals.join(orders.hint("merge"), "order_id", "inner" if needs_order else "left")
            .join(lines.hint("merge"), "order_id", "inner" if flt.on_items else "left")
            .join(reviews.hint("merge"), "order_id", "inner" if flt.review_score else "left")
        )
        repeats = F.coalesce("lines", F.lit(1)) * F.coalesce("reviews", F.lit(1))
        times = F.when(F.col("known"), repeats).otherwise(1)
    return totals.groupBy("payment_type").agg(
        F.sum(F.col("payments") * times).alias("total"),
        money_total(F.col("value") * times).alias("total_value"),
    )


def sales_payments(wh: Warehouse, flt: SalesFilter = NO_FILTER, compat: bool = True) -> DataFrame:
    return _payment_totals(wh, flt, compat).orderBy(F.desc("total"), "payment_type")


def _seller_rows(
    wh: Warehouse, flt: SalesFilter, compat: bool
) -> DataFrame:
    """One row per seller and order."""
    return _order_rows(
        wh,
        filtered_lines(wh, flt),
        flt,
        compat,
        "seller_id",
        "order_status",
        "is_late_delivery",
        "delivery_seconds",
        "order_known",
        known_orders_only=True,
    )


def _named_sellers(wh: Warehouse, figures: DataFrame) -> DataFrame:
    places = wh.table("stg_sellers").select("seller_id", "seller_city", "seller_state")
    return figures.join(places, "seller_id", "inner")


def sales_seller_leaderboard(
    wh: Warehouse, flt: SalesFilter = NO_FILTER, limit: int = 50, compat: bool = True
) -> DataFrame:
    bounded("limit", limit, 1, 100)
    seconds, rows = F.col("delivery_seconds"), weighted("items")
    days = mean_days(F.sum(seconds * rows), F.sum(F.when(seconds.isNotNull(), rows)))
    figures = (
        _seller_rows(wh, flt, compat)
        .groupBy("seller_id")
        .agg(
            _known(F.col("order_status") == DELIVERED).alias("delivered_orders"),
            money_total(weighted("gmv")).alias("total_gmv"),
            _score().alias("avg_review_score"),
            _late_share().alias("late_delivery_pct"),
            rounded(or_zero(days), 2).alias("avg_delivery_days"),
        )
        .filter(F.col("delivered_orders") > 0)
    )
    return (
        _named_sellers(wh, figures)
        .orderBy(F.desc("avg_review_score"), F.desc("total_gmv"), "seller_id")
        .limit(limit)
        .select(
            "seller_id",
            "seller_city",
            "seller_state",
            "delivered_orders",
            "total_gmv",
            "avg_review_score",
            "late_delivery_pct",
            "avg_delivery_days",
        )
    )


def insight_best_category(
    wh: Warehouse, flt: SalesFilter = NO_FILTER, compat: bool = True
) -> DataFrame:
    lines = filtered_lines(wh, flt, category=True, order=False)
    if not compat:
        lines = lines.withColumn(CATEGORY, known_category())
    return (
        _plain_sales(wh, flt, lines, CATEGORY)
        .orderBy(F.desc("gmv"), CATEGORY)
        .limit(1)
        .select(known_category().alias("category"), "gmv")
    )


def insight_top_city(wh: Warehouse, flt: SalesFilter = NO_FILTER) -> DataFrame:
    lines = filtered_lines(wh, flt, buyer=True)
    return (
        _plain_sales(wh, flt, lines, "customer_city", "customer_state")
        .orderBy(F.desc("gmv"), "customer_city", "customer_state")
        .limit(1)
        .select(
            F.coalesce("customer_city", F.lit("unknown")).alias("city"),
            F.coalesce("customer_state", F.lit("unknown")).alias("state"),
            "gmv",
        )
    )


def insight_top_payment(
    wh: Warehouse, flt: SalesFilter = NO_FILTER, compat: bool = True
) -> DataFrame:
    totals = _payment_totals(wh, flt, compat)
    return totals.orderBy(F.desc("total"), "payment_type").limit(1).select("payment_type", "total")


def insight_top_rated_seller(
    wh: Warehouse, flt: SalesFilter = NO_FILTER, compat: bool = True, more_than: int = 10
) -> DataFrame:
    figures = (
        _seller_rows(wh, flt, compat)
        .groupBy("seller_id")
        .agg(_known(F.lit(True)).alias("orders"), _score().alias("avg_review_score"))
        .filter(F.col("orders") > more_than)
    )
    return (
        _named_sellers(wh, figures)
        .orderBy(F.desc("avg_review_score"), "seller_id")
        .limit(1)
        .select("seller_city", "seller_state", "avg_review_score")
    )


def dashboard(
    wh: Warehouse, flt: SalesFilter = NO_FILTER, compat: bool = True
) -> dict[str, DataFrame]:
    """The queries of one dashboard refresh, by name."""
    return {
        "summary": sales_summary(wh, flt, compat),
        "map": sales_map(wh, flt, compat=compat),
        "categories": sales_categories(wh, flt, compat=compat),
        "trend": sales_trend(wh, flt, compat),
        "payments": sales_payments(wh, flt, compat),
        "sellers": sales_seller_leaderboard(wh, flt, compat=compat),
        "best_category": insight_best_category(wh, flt, compat),
        "top_city": insight_top_city(wh, flt),
        "top_payment": insight_top_payment(wh, flt, compat),
        "top_rated_seller": insight_top_rated_seller(wh, flt, compat),
    }
