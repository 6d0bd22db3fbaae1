"""What a refresh has to write when datasets only gained batches.

Staged rows depend on one raw row each, so new ones are added in a folder of their own. Orders and lines lie by
purchase month: the months that new records reach are written again, out of their stored rows and the new ones,
and all other months keep their files. The work on a table grows with the batch and with the months it reaches;
looking the batch up reads the columns of orders (and the keys of customers) that it needs, without shuffling them
unless the batch is large itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlake.operators import dimensions, facts, staging
from bazaarlake.operators.skew import HotKeys
from bazaarlake.plans.warehouse import Warehouse
from bazaarlake.sources.storage import Stored, TableStore

# Manifest entry that names the raw batches a version holds.
BATCHES = "_batches"
MONTH = "purchase_month"
# Folders of added rows after which a table is written anew as a whole.
MOST_FOLDERS = 64

# Tables of which each row comes from one raw row, with the dataset. Geolocation only says where customers are.
ROWS = {
    "stg_customers": "customers",
    "stg_orders": "orders",
    "stg_order_items": "order_items",
    "stg_payments": "order_payments",
    "stg_reviews": "order_reviews",
    "dim_customers": "customers",
    "fct_payments": "order_payments",
}
MONTHS = ("order_heads", "order_lines")


def to_json(batches: Mapping[str, Mapping[int, str]]) -> str:
    return json.dumps({dataset: sorted(known.items()) for dataset, known in batches.items()})


def held(current: Mapping[str, Stored]) -> dict[str, dict[int, str]]:
    """The raw batches that a version holds, by dataset; datasets that it knows nothing of are left out."""
    if BATCHES not in current:
        return {}
    return {dataset: dict(map(tuple, known)) for dataset, known in json.loads(current[BATCHES].path).items()}


def arrived(
    current: Mapping[str, Stored], batches: Mapping[str, Mapping[int, str]], touched: Iterable[str]
) -> dict[str, list[int]]:
    """New batches of the touched datasets that only gained some.

    A dataset of which a known batch was stored again or taken out is not among them, nor is any if a table has
    its rows in too many folders.
    """
    if any(isinstance(t.folders, list) and len(t.folders) >= MOST_FOLDERS for n, t in current.items() if n in ROWS):
        return {}
    known = held(current)
    return {
        dataset: sorted(batches[dataset].keys() - known[dataset].keys())
        for dataset in touched
        if dataset in known and known[dataset].items() <= batches[dataset].items()
    }


@dataclass
class Increment:
    """The tables of the current version and the new records of some datasets."""

    store: TableStore
    current: Mapping[str, Stored]
    news: Mapping[str, list[int]]
    version: int

    def reaches(self, name: str, needs: set[str], touched: set[str]) -> bool:
        """Whether the table can be brought up to date by what is new."""
        if name not in self.current or not needs & touched <= self.news.keys():
            return False
        return name in MONTHS or (name in ROWS and needs & touched <= {ROWS[name]})

    def raw(self, dataset: str) -> DataFrame:
        """New records of a dataset, as raw text."""
        return self.store.raw(dataset, batches=self.news.get(dataset, []))

    def update(self, name: str, wh: Warehouse, lookup: str | None) -> Stored:
        """The table with what is new, written; ``wh`` has the tables written before."""
        old = self.current[name]
        if name in ROWS:
            if not self.news[ROWS[name]]:
                return old
            return self.store.add_rows(name, self._rows(name, wh), self.version, old, lookup)
        rows, months = self._heads(wh) if name == "order_heads" else self._lines(wh)
        if not months:
            return old
        return self.store.replace_partitions(name, rows, self.version, old, MONTH, months, lookup)

    def _rows(self, name: str, wh: Warehouse) -> DataFrame:
        raw = self.raw(ROWS[name])
        if name == "dim_customers":
            customers = staging.stg_customers(raw)
            return dimensions.dim_customers(customers, wh.table("stg_geolocation"), HotKeys())
        if name == "fct_payments":
            return facts.fct_payments(staging.stg_payments(raw))
        return getattr(staging, name)(raw)

    def _buyers(self) -> DataFrame:
        """New customers as buyers of an order."""
        return facts.buyers(staging.stg_customers(self.raw("customers")))

    def _renewed(self, rows: DataFrame) -> DataFrame:
        """Rows of orders with the columns of their buyer where the buyer is new."""
        if not self.news.get("customers"):
            return rows
        new = self._buyers().select(
            F.col("customer_id").alias("_buyer"), *(F.col(c).alias(f"_{c}") for c in facts.BUYER_COLUMNS)
        )
        came = rows["customer_known"].isNull() & F.col("_customer_known").isNotNull()
        joined = rows.join(new, rows["customer_id"] == F.col("_buyer"), "left")
        return joined.select(
            *(
                F.when(came, F.col(f"_{c}")).otherwise(rows[c]).alias(c) if c in facts.BUYER_COLUMNS else rows[c]
                for c in rows.columns
            )
        )

    def _waited_for_buyers(self) -> set:
        """Months of stored orders whose buyer is new."""
        if not self.news.get("customers"):
            return set()
        heads = self.store.open(self.current["order_heads"]).filter("customer_known IS NULL")
        return _months(heads.join(self._buyers(), "customer_id", "left_semi"))

    def _heads(self, wh: Warehouse) -> tuple[DataFrame, set]:
        old = self.store.open(self.current["order_heads"])
        months = self._waited_for_buyers()
        core = None
        if self.news.get("orders"):
            core = facts.order_core(staging.stg_orders(self.raw("orders")))
            months |= _months(core)
        rows = self._renewed(old.filter(_in(months)))
        if core is not None:
            # Customers are looked through for those of the new orders, and only these are joined.
            known = wh.table("stg_customers").join(core.select("customer_id"), "customer_id", "left_semi")
            rows = rows.unionByName(facts.order_heads(core, known, HotKeys()))
        return rows.select(old.columns), months

    def _lines(self, wh: Warehouse) -> tuple[DataFrame, set]:
        old = self.store.open(self.current["order_lines"])
        items = staging.stg_order_items(self.raw("order_items"))
        orders = staging.stg_orders(self.raw("orders")).select("order_id")
        fresh = items
        woken = False
        if self.news.get("orders"):
            # Lines of unknown orders have no month.
            orphans = old.filter(F.col(MONTH).isNull() & F.col("order_known").isNull())
            waited = orphans.join(orders, "order_id", "left_semi")
            woken = not waited.isEmpty()
            if woken:
                fresh = fresh.unionByName(waited.select(items.columns))
        heads = wh.table("order_heads").join(fresh.select("order_id"), "order_id", "left_semi")
        fresh = facts.order_lines(fresh, heads, HotKeys())
        months = _months(fresh) | self._waited_for_buyers() | ({None} if woken else set())
        stay = old.filter(_in(months))
        if woken:
            waiting = F.col(MONTH).isNull() & F.col("order_known").isNull()
            left = stay.filter(waiting).join(orders, "order_id", "left_anti").select(old.columns)
            stay = stay.filter(~waiting).unionByName(left)
        return self._renewed(stay).unionByName(fresh.select(old.columns)), months


def _months(rows: DataFrame) -> set:
    """Purchase months of rows, as many as the calendar has."""
    return {row[0] for row in rows.select(MONTH).distinct().collect()}


def _in(months: set) -> Column:
    month = F.col(MONTH)
    found = month.isin(sorted(m for m in months if m is not None))
    return F.coalesce(found, F.lit(False)) if None not in months else F.coalesce(found | month.isNull(), F.lit(False))
