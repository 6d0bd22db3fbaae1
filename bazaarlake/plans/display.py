"""Display columns on top of the sales figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlake.functions.bands import falling_band, rising_band
from bazaarlake.functions.numeric import rounded, rounded_ratio
from bazaarlake.operators.filters import NO_FILTER, SalesFilter
from bazaarlake.plans.sales import sales_map, sales_seller_leaderboard, sales_summary
from bazaarlake.plans.warehouse import Warehouse

# Bubble size on the map and the labels of the headline figures.
GMV_PER_UNIT, RADIUS_FACTOR, LARGEST_RADIUS = 500.0, 3.0, 50.0
REVIEW_LABELS = ("Excellent", "Good", "Needs Attention")
ON_TRACK, AT_RISK = "On Track", "At Risk"


def map_layer(
    wh: Warehouse, flt: SalesFilter = NO_FILTER, limit: int = 200, compat: bool = True
) -> DataFrame:
    """Bubbles of the sales map, placed at the mean position of a city's buyers."""
    bubbles = sales_map(wh, flt, limit, compat)
    radius = F.sqrt(F.col("gmv") / GMV_PER_UNIT) * RADIUS_FACTOR

    def centre(name: str) -> Column:
        # Decimals add up to the same total in any row order.
        return rounded_ratio(F.sum(F.col(name).cast("decimal(18,9)")), F.count(name), 6)

    places = (
        wh.table("dim_customers")
        .groupBy(F.col("customer_city").alias("city"), F.col("customer_state").alias("state"))
        .agg(
            centre("customer_latitude").alias("latitude"),
            centre("customer_longitude").alias("longitude"),
        )
    )
    here = F.col("b.city").eqNullSafe(F.col("p.city")) & F.col("b.state").eqNullSafe(F.col("p.state"))
    placed = bubbles.alias("b").join(places.alias("p"), here, "left")
    return placed.select("b.*", "latitude", "longitude").select(
        *bubbles.columns,
        rounded(F.least(radius, F.lit(LARGEST_RADIUS)), 6).alias("bubble_radius"),
        falling_band(F.col("avg_review_score"), 4, 3).alias("review_color"),
        "latitude",
        "longitude",
    ).orderBy(F.desc("gmv"), "city", "state", "top_category")


def kpi_bands(wh: Warehouse, flt: SalesFilter = NO_FILTER, compat: bool = True) -> DataFrame:
    late = F.col("late_delivery_rate")
    return sales_summary(wh, flt, compat).select(
        "*",
        falling_band(F.col("avg_review_score"), 4.5, 3.5, REVIEW_LABELS).alias("review_band"),
        F.when(late <= 10, ON_TRACK).otherwise(AT_RISK).alias("late_band"),
    )


def seller_bands(
    wh: Warehouse, flt: SalesFilter = NO_FILTER, limit: int = 50, compat: bool = True
) -> DataFrame:
    return sales_seller_leaderboard(wh, flt, limit, compat).select(
        "*",
        falling_band(F.col("avg_review_score"), 4.5, 3.5).alias("review_color"),
        rising_band(F.col("late_delivery_pct"), 10, 20).alias("late_color"),
    )
