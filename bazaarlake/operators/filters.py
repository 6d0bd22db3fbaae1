"""The ten sales filters and where each of them applies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ALL_YEARS = "All Years"

# First and last calendar month of the April-to-March quarters.
FISCAL_QUARTERS = {1: (4, 6), 2: (7, 9), 3: (10, 12), 4: (1, 3)}


def bounded(name: str, value: int, low: int, high: int | None = None) -> int:
    """Argument check made before a plan is built."""
    if value < low or (high is not None and value > high):
        raise ValueError(f"{name} must be between {low} and {high}, got {value}")
    return value


def _first_year(text: str | None) -> int | None:
    """Starting year of '2017-2018'; None for no or unreadable text."""
    if not text or text == ALL_YEARS:
        return None
    try:
        return int(text.split("-")[0])
    except ValueError:
        return None


@dataclass(frozen=True)
class SalesFilter:
    """All given conditions hold; a falsy value means no condition."""

    financial_year: str | None = ALL_YEARS
    quarter: int | None = None
    month: int | None = None
    customer_state: str | None = None
    customer_city: str | None = None
    seller_state: str | None = None
    product_category: str | None = None
    payment_type: str | None = None
    order_status: str | None = None
    review_score: int | None = None

    def __post_init__(self):
        if self.quarter and self.quarter not in FISCAL_QUARTERS:
            raise ValueError(f"quarter must be between 1 and 4, got {self.quarter}")

    @property
    def needs_buyer(self) -> bool:
        return bool(self.customer_state or self.customer_city)

    @property
    def needs_category(self) -> bool:
        return bool(self.product_category)

    @property
    def needs_seller(self) -> bool:
        return bool(self.seller_state)

    @property
    def on_items(self) -> bool:
        return self.needs_category or self.needs_seller

    def order_conditions(self) -> list[Column]:
        """Conditions on the order and its buyer.

        A financial year starts on the first of a month, so the month key says
        the same as the timestamp range; stored facts are partitioned by it
        and skip the other months' files.
        """
        conditions = []
        start = _first_year(self.financial_year)
        bought, month_key = F.col("order_purchase_timestamp"), F.col("purchase_month")
        if start is not None:
            low, high = (f"{year:04d}-04" for year in (start, start + 1))
            conditions += [(month_key >= low) & (month_key < high)]
            conditions += [
                bought >= F.lit(f"{low}-01").cast("timestamp_ntz"),
                bought < F.lit(f"{high}-01").cast("timestamp_ntz"),
            ]
        calendar_month = F.substring(month_key, 6, 2)
        if self.quarter:
            first, last = FISCAL_QUARTERS[self.quarter]
            conditions.append(calendar_month.between(f"{first:02d}", f"{last:02d}"))
        if self.month:
            conditions.append(calendar_month == f"{self.month:02d}")
        if self.order_status:
            conditions.append(F.col("order_status") == self.order_status)
        if self.customer_state:
            conditions.append(F.col("customer_state") == self.customer_state)
        if self.customer_city:
            conditions.append(F.col("customer_city") == self.customer_city)
        return conditions

    def item_conditions(self) -> list[Column]:
        conditions = []
        if self.seller_state:
            conditions.append(F.col("seller_state") == self.seller_state)
        if self.product_category:
            conditions.append(F.col("product_category_name_english") == self.product_category)
        return conditions


NO_FILTER = SalesFilter()
