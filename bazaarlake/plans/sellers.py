"""Lookups and rankings over the seller scores report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlake.functions.bands import recommendation
from bazaarlake.functions.numeric import number_value
from bazaarlake.operators.filters import bounded

# Names of the score's parts, by report column.
BREAKDOWN = {
    "on_time_delivery_rate": "on_time_delivery_rate_40_percent",
    "avg_review_score": "average_review_score_30_percent",
    "cancellation_rate": "order_cancellation_rate_20_percent",
    "revenue_growth_rate": "average_order_value_growth_10_percent",
}


def _card(*extra: Column | str) -> list[Column | str]:
    """Columns shown for one seller; report cells may be text or empty."""
    return [
        *extra,
        "seller_id",
        "seller_city",
        "seller_state",
        number_value(F.col("orders")).cast("bigint").alias("orders"),
        number_value(F.col("gmv")).alias("gmv"),
        number_value(F.col("performance_score")).alias("performance_score"),
        "risk_tier",
        *[number_value(F.col(name)).alias(shown) for name, shown in BREAKDOWN.items()],
        recommendation(F.col("risk_tier")).alias("recommendation"),
    ]


def seller_score_lookup(scores: DataFrame, seller_id: str) -> DataFrame:
    """One seller's score card; no rows if the seller is unknown."""
    return scores.filter(F.col("seller_id") == seller_id).select(*_card())


def seller_score_leaderboard(
    scores: DataFrame, sort: str = "best", min_orders: int = 1, limit: int = 10
) -> DataFrame:
    bounded("limit", limit, 1, 5000)
    bounded("min_orders", min_orders, 1)
    if sort not in ("best", "worst"):
        raise ValueError(f"sort must be 'best' or 'worst', got {sort!r}")
    matching = scores.filter(number_value(F.col("orders")) >= min_orders)
    score = number_value(F.col("performance_score"))
    order = [F.desc("_score") if sort == "best" else F.asc("_score"), F.asc("seller_id")]
    top = matching.withColumn("_score", score).orderBy(*order).limit(limit)
    # At most ``limit`` rows are numbered.
    rank = F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank")
    total = matching.agg(F.count(F.lit(1)).alias("total_matching_sellers"))
    return top.crossJoin(F.broadcast(total)).select(
        *_card(rank),
        "total_matching_sellers",
        F.least(F.lit(limit).cast("bigint"), "total_matching_sellers").alias("count_returned"),
    )


def seller_detail(scores: DataFrame, seller_id: str) -> DataFrame:
    """Score card with the seller's rank among all, best first.

    The rank is the number of sellers ahead plus one: a filtered count, where
    a rank function would sort every seller in one task.
    """
    one = scores.filter(F.col("seller_id") == seller_id)
    score = number_value(F.col("performance_score"))
    # One row, as seller_id is a key of the report.
    own = one.agg(F.max(score).alias("_own_score"))
    tie = (score == F.col("_own_score")) & (F.col("seller_id") < seller_id)
    ahead = (
        scores.crossJoin(F.broadcast(own))
        .filter((score > F.col("_own_score")) | tie)
        .agg((F.count(F.lit(1)) + 1).alias("rank"))
    )
    return one.crossJoin(F.broadcast(ahead)).select(*_card("rank"))


def seller_tier_distribution(scores: DataFrame) -> DataFrame:
    return scores.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("sellers"))
