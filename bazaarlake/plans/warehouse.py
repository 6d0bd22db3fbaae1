"""The tables of the warehouse, computed on demand or read from storage."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.functions.numeric import as_double
from bazaarlake.operators import dimensions, facts, staging
from bazaarlake.operators.skew import ROW, HotKeys, SkewProfile, measure, scan_order, skew_join
from bazaarlake.session import size_tasks
from bazaarlake.sources.schemas import INGEST_SEQ
from bazaarlake.sources.tpch import TpchSource

# Join columns whose keys may be uneven, by the table on the big side.
JOIN_COLUMNS = {
    "stg_order_items": ["order_id", "product_id", "seller_id"],
    "stg_orders": ["customer_id"],
    "stg_customers": ["customer_zip_code_prefix"],
    "stg_sellers": ["seller_zip_code_prefix"],
    "products": ["product_category_name"],
}


class Warehouse:
    """Names to DataFrames.

    ``raw`` maps the nine datasets to DataFrames. ``stored`` maps table names
    to a reader and takes precedence, so a warehouse written by the build job
    answers the same queries without recomputing anything.
    """

    def __init__(
        self,
        raw: Mapping[str, DataFrame] | None = None,
        stored: Mapping[str, Callable[[], DataFrame]] | None = None,
        skew: SkewProfile | None = None,
    ):
        self.raw = {} if raw is None else raw
        self.stored = dict(stored or {})
        self.skew = skew or SkewProfile()
        # Rows of the tables counted so far, with the session they are read in.
        self.counted: dict[str, tuple[SparkSession, int]] = {}
        self._tables: dict[str, DataFrame] = {}

    @classmethod
    def from_tpch(cls, spark: SparkSession, folder: str) -> "Warehouse":
        return cls(raw=TpchSource(spark, folder))

    # -- skew ---------------------------------------------------------------

    def hot(self, column: str) -> HotKeys:
        """Hot keys of a join column; each table is measured once, in one pass, after its rows are counted."""
        for table, columns in JOIN_COLUMNS.items():
            if column in columns and column not in self.skew.measured:
                rows = self._measurable(table)
                self.counted[table] = rows.sparkSession, rows.count()
                self.fit_session()
                self.skew = self.skew.merge(measure(rows, columns))
        return self.skew[column]

    def fit_session(self) -> None:
        """Size the session's tasks for the tables counted so far; its settings may have changed since."""
        for spark, rows in self.counted.values():
            size_tasks(spark, rows)

    def _measurable(self, table: str) -> DataFrame:
        # Categories are measured before they are translated.
        return self.raw["products"] if table == "products" else self.table(table)

    # -- tables -------------------------------------------------------------

    def report(self, name: str, compute: Callable[["Warehouse"], DataFrame]) -> DataFrame:
        """A report as it is stored, else computed once."""
        if name not in self._tables and name not in self.stored:
            self._tables[name] = compute(self)
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        self.fit_session()
        if name not in self._tables:
            if name in self.stored:
                self._tables[name] = self.stored[name]()
            else:
                self._tables[name] = getattr(self, f"_{name}")()
        return self._tables[name]

    def keep(self, name: str, reader: Callable[[], DataFrame]) -> None:
        """Read a table from storage from now on, also inside other tables."""
        self.stored[name] = reader
        # Plans that were to compute the table are made again on demand.
        read = {n: df for n, df in self._tables.items() if n in self.stored and n != name}
        self._tables = read

    def _stg_customers(self) -> DataFrame:
        return staging.stg_customers(self.raw["customers"])

    def _stg_orders(self) -> DataFrame:
        return staging.stg_orders(self.raw["orders"])

    def _stg_order_items(self) -> DataFrame:
        return staging.stg_order_items(self.raw["order_items"])

    def _stg_payments(self) -> DataFrame:
        return staging.stg_payments(self.raw["order_payments"])

    def _stg_reviews(self) -> DataFrame:
        return staging.stg_reviews(self.raw["order_reviews"])

    def _stg_products(self) -> DataFrame:
        return staging.stg_products(
            self.raw["products"],
            self.raw["category_translation"],
            self.hot("product_category_name"),
        )

    def _stg_sellers(self) -> DataFrame:
        return staging.stg_sellers(self.raw["sellers"])

    def _stg_geolocation(self) -> DataFrame:
        return staging.stg_geolocation(self.raw["geolocation"])

    def _dim_customers(self) -> DataFrame:
        return dimensions.dim_customers(
            self.table("stg_customers"),
            self.table("stg_geolocation"),
            self.hot("customer_zip_code_prefix"),
        )

    def _dim_sellers(self) -> DataFrame:
        return dimensions.dim_sellers(
            self.table("stg_sellers"),
            self.table("stg_geolocation"),
            self.hot("seller_zip_code_prefix"),
        )

    def _dim_products(self) -> DataFrame:
        return dimensions.dim_products(self.table("stg_products"))

    def _dim_dates(self) -> DataFrame:
        return dimensions.dim_dates(self.table("stg_orders"))

    def _order_core(self) -> DataFrame:
        if "order_heads" in self.stored:
            return self.table("order_heads")
        return facts.order_core(self.table("stg_orders"))

    def _order_heads(self) -> DataFrame:
        return facts.order_heads(
            self.table("order_core"), self.table("stg_customers"), self.hot("customer_id")
        )

    def _order_lines(self) -> DataFrame:
        return facts.order_lines(
            self.table("stg_order_items"), self.table("order_heads"), self.hot("order_id")
        )

    def _fct_orders(self) -> DataFrame:
        return self.table("order_heads").select(facts.FCT_ORDERS)

    def _fct_order_items(self) -> DataFrame:
        # Needs nothing of the buyer, so the buyer is not joined.
        return self.lines().select(facts.FCT_ORDER_ITEMS)

    def _fct_payments(self) -> DataFrame:
        return facts.fct_payments(self.table("stg_payments"))

    # -- the start of most queries -----------------------------------------

    def orders(self, buyer: bool = False) -> DataFrame:
        return self.table("order_heads" if buyer else "order_core")

    def lines(
        self,
        buyer: bool = False,
        category: bool = False,
        seller: tuple[str, ...] = (),
        order: bool = True,
    ) -> DataFrame:
        """Order lines with just the lookups a query asks for.

        Orders are unique, so a query that needs nothing of them goes without.

        Lookups come before the order join: they meet rows fresh from the
        scan, and what follows can reuse the partitioning by order.
        """
        stored = "order_lines" in self.stored
        items = self.table("order_lines") if stored else self.table("stg_order_items")
        if any(self.hot(key) for key in JOIN_COLUMNS["stg_order_items"]):
            # Numbered at the scan, where the numbering is repeatable.
            items = items.withColumn(ROW, scan_order())
        if category:
            names = self.table("dim_products").select("product_id", "product_category_name_english")
            items = skew_join(items, names, "product_id", self.hot("product_id"))
        if seller:
            sellers = self.table("stg_sellers").select(
                "seller_id", *seller, F.lit(True).alias("seller_known")
            )
            items = skew_join(items, sellers, "seller_id", self.hot("seller_id"))
        if stored:
            return items.drop(ROW)
        if not (order or buyer):
            return items.withColumn("item_gmv", facts.line_gmv()).drop(ROW)
        return facts.order_lines(items, self.orders(buyer), self.hot("order_id")).drop(ROW)


def published(df: DataFrame) -> DataFrame:
    """A table as users see it: no internal columns, decimals as doubles."""
    return df.select(
        *[
            as_double(F.col(name)).alias(name) if kind.startswith("decimal") else F.col(name)
            for name, kind in df.dtypes
            if name != INGEST_SEQ
        ]
    )
