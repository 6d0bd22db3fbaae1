"""Labels derived from figures: risk tiers, customer segments, display bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score thresholds and the text shown for each tier.
LOW_RISK_FROM = 80
WATCHLIST_FROM = 60
RECOMMENDATIONS = {
    "high_risk": "Audit fulfillment process, shipping promise, and product quality before increasing seller exposure.",
    "watchlist": "Monitor late deliveries and review trend weekly; offer operational coaching.",
}
HEALTHY = "Seller is healthy; consider higher marketplace visibility."

# Customer segments.
CHAMPION_ORDERS, CHAMPION_SPEND = 3, 500
LOYAL_ORDERS = 2
RECENT_DAYS, AT_RISK_DAYS = 90, 365

# Colours of the good, middling and bad display bands.
GREEN, AMBER, RED = "#16A34A", "#F59E0B", "#DC2626"


def risk_tier(score: Column) -> Column:
    return (
        F.when(score >= LOW_RISK_FROM, "low_risk")
        .when(score >= WATCHLIST_FROM, "watchlist")
        .otherwise("high_risk")
    )


def recommendation(tier: Column) -> Column:
    chain = F
    for name, advice in RECOMMENDATIONS.items():
        chain = chain.when(tier == name, advice)
    return chain.otherwise(HEALTHY)


def rfm_segment(recency_days: Column, frequency: Column, monetary: Column) -> Column:
    return (
        F.when((frequency >= CHAMPION_ORDERS) & (monetary >= CHAMPION_SPEND), "champions")
        .when(frequency >= LOYAL_ORDERS, "loyal")
        .when(recency_days <= RECENT_DAYS, "recent")
        .when(recency_days > AT_RISK_DAYS, "at_risk")
        .otherwise("needs_attention")
    )


def falling_band(value: Column, good: float, fair: float, labels=(GREEN, AMBER, RED)) -> Column:
    """Label for figures where more is better."""
    return F.when(value >= good, labels[0]).when(value >= fair, labels[1]).otherwise(labels[2])


def rising_band(value: Column, good: float, fair: float, labels=(GREEN, AMBER, RED)) -> Column:
    """Label for figures where less is better."""
    return F.when(value <= good, labels[0]).when(value <= fair, labels[1]).otherwise(labels[2])
