"""Star-join aggregation without the star join's row multiplication.

Lines are summed per order (and one or two further keys) before anything else
of the order is attached. Joining payments or reviews then works on one row
per order, with counts in place of repeated rows:

* a left join of lines to reviews repeats each line once per review, so its
  sums are the line sums times the order's review count;
* a distinct count of orders becomes a count of rows, or a sum of flags.

The figures are those of the row-by-row join; the largest order costs no more
than the smallest, because partial aggregation shrinks it where it is read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlake.functions.numeric import cents, or_zero
from bazaarlake.operators.filters import SalesFilter
from bazaarlake.plans.warehouse import Warehouse

CATEGORY = "product_category_name_english"


def where_all(df: DataFrame, conditions: list[Column]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, conditions)) if conditions else df


def filtered_orders(wh: Warehouse, flt: SalesFilter, buyer: bool = False) -> DataFrame:
    orders = wh.orders(buyer=buyer or flt.needs_buyer)
    return where_all(orders, flt.order_conditions())


def filtered_lines(
    wh: Warehouse,
    flt: SalesFilter,
    buyer: bool = False,
    category: bool = False,
    seller: tuple[str, ...] = (),
    order: bool = True,
) -> DataFrame:
    """Lines under the order, buyer, seller and product conditions.

    Without ``order`` the caller needs no column of the order.
    """
    if flt.needs_seller and "seller_state" not in seller:
        seller = (*seller, "seller_state")
    lines = wh.lines(
        buyer=buyer or flt.needs_buyer,
        category=category or flt.needs_category,
        seller=seller,
        order=order or bool(flt.order_conditions()),
    )
    return where_all(lines, flt.order_conditions() + flt.item_conditions())


def per_order(wh: Warehouse, lines: DataFrame, *keys: str) -> DataFrame:
    """Line sums per order and ``keys``, money in cents.

    Grouping shrinks every order where it is read, so one plan serves all data.
    """
    return lines.groupBy("order_id", *keys).agg(
        F.count(F.lit(1)).alias("items"),
        F.sum(cents("price")).alias("price"),
        F.sum(cents("freight_value")).alias("freight"),
        F.sum(cents("item_gmv")).alias("gmv"),
        F.count("item_gmv").alias("priced"),
    )


def review_stats(wh: Warehouse, score: int | None = None) -> DataFrame:
    reviews = wh.table("stg_reviews")
    if score:
        reviews = reviews.filter(F.col("review_score") == score)
    return reviews.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("reviews"),
        F.count("review_score").alias("scores"),
        F.sum("review_score").alias("score_sum"),
    )


def with_reviews(
    df: DataFrame,
    wh: Warehouse,
    score: int | None = None,
    compat: bool = True,
    known_orders_only: bool = False,
) -> DataFrame:
    """Attach review weights to rows holding ``items`` lines of one order.

    ``weight``      rows each line turns into (1 unless ``compat``)
    ``score_sum``, ``score_rows``  parts of the mean score over those rows;
    without ``compat`` each line counts once with its order's mean score.
    A ``score`` condition keeps only orders having a review with that score.
    ``known_orders_only`` leaves lines without an order unreviewed.
    """
    stats = review_stats(wh, score).hint("merge")
    joined = df.join(stats, "order_id", "inner" if score else "left")
    if known_orders_only and score:
        joined = joined.filter("order_known")
    elif known_orders_only:
        for name in ("reviews", "scores", "score_sum"):
            joined = joined.withColumn(name, F.when(F.col("order_known"), F.col(name)))
    items = F.col("items")
    if compat:
        weight = F.coalesce("reviews", F.lit(1))
        score_sum = items * or_zero(F.col("score_sum"))
        score_rows = items * or_zero(F.col("scores"))
    else:
        scored = F.col("scores") > 0
        weight = F.lit(1)
        score_sum = F.when(scored, items * (F.col("score_sum") / F.col("scores"))).otherwise(0.0)
        score_rows = F.when(scored, items).otherwise(0)
    return joined.select(
        *df.columns,
        weight.alias("weight"),
        score_sum.alias("score_sum"),
        score_rows.alias("score_rows"),
    )


def paid_with(df: DataFrame, wh: Warehouse, payment_type: str | None) -> DataFrame:
    """Rows of orders that have a payment of the given type."""
    if not payment_type:
        return df
    payments = wh.table("fct_payments").filter(F.col("payment_type") == payment_type)
    return df.join(payments.select("order_id").hint("merge"), "order_id", "left_semi")


def reviewed_with(df: DataFrame, wh: Warehouse, score: int | None) -> DataFrame:
    """Rows of orders that have a review with the given score."""
    if not score:
        return df
    reviews = wh.table("stg_reviews").filter(F.col("review_score") == score)
    return df.join(reviews.select("order_id").hint("merge"), "order_id", "left_semi")


def weighted(name: str) -> Column:
    return F.col(name) * F.col("weight")


def mean_score() -> Column:
    """Mean score of a group, NULL when nothing was scored."""
    rows = F.sum("score_rows")
    return F.when(rows > 0, F.sum("score_sum").cast("double") / rows)
