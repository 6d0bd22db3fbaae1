"""Marketplace datasets derived from TPC-H-shaped parquet tables.

Only expressions and joins over the given tables, so every derived dataset
grows with them. Values arrive typed; staging leaves typed values alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.functions.casts import MONEY
from bazaarlake.sources.schemas import COLUMNS, INGEST_SEQ

DAY = 86400

# English names of product categories; 'standard' has none.
TRANSLATION = {
    "economy": "budget",
    "large": "large_goods",
    "medium": "medium_goods",
    "promo": "promotions",
    "small": "small_goods",
}

PAYMENT_BY_PRIORITY = {
    "1-URGENT": "credit_card",
    "2-HIGH": "boleto",
    "3-MEDIUM": "credit_card",
    "4-NOT SPECIFIED": "debit_card",
    "5-LOW": "voucher",
}


def _mapped(column: Column, mapping: dict[str, str]) -> Column:
    chain = F
    for key, value in mapping.items():
        chain = chain.when(column == key, value)
    return chain


def _key(name: str) -> Column:
    return F.col(name).cast("string")


def _after_order(seconds: Column | int) -> Column:
    """Order date plus a spread within the day plus ``seconds``."""
    offset = (F.col("o_orderkey") * 7919) % DAY + seconds
    return F.timestamp_add("SECOND", offset.cast("int"), F.col("o_orderdate"))


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


class TpchSource(Mapping):
    """The nine datasets of one table folder, each planned when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._read = lru_cache(self._scan)
        self._planned: dict[str, DataFrame] = {}

    def __getitem__(self, dataset: str) -> DataFrame:
        if dataset not in self._planned:
            rows = getattr(self, f"_{dataset}")()
            self._planned[dataset] = rows.select(*COLUMNS[dataset], INGEST_SEQ)
        return self._planned[dataset]

    def __iter__(self) -> Iterator[str]:
        return iter(COLUMNS)

    def __len__(self) -> int:
        return len(COLUMNS)

    def _scan(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    def _placed(self, table: str, nation_key: str) -> DataFrame:
        nation, region = self._read("nation"), self._read("region")
        placed = self._read(table).join(nation, F.col(nation_key) == nation["n_nationkey"])
        return placed.join(region, F.col("n_regionkey") == region["r_regionkey"])

    def _customers(self) -> DataFrame:
        buyers = self._placed("customer", "c_nationkey")
        orders = self._read("orders").select("o_orderkey", "o_custkey")
        return orders.join(buyers, orders["o_custkey"] == buyers["c_custkey"]).select(
            F.concat(F.lit("c"), _key("o_orderkey")).alias("customer_id"),
            _key("o_custkey").alias("customer_unique_id"),
            (1000 + F.col("o_custkey") % 500).cast("int").alias("customer_zip_code_prefix"),
            F.lower("n_name").alias("customer_city"),
            F.upper("r_name").alias("customer_state"),
            F.col("o_orderkey").alias(INGEST_SEQ),
        )

    def _orders(self) -> DataFrame:
        key = F.col("o_orderkey")
        status = (
            F.when((F.col("o_orderstatus") == "O") & (key % 4 == 0), "shipped")
            .when((F.col("o_orderstatus") == "P") & (key % 3 == 0), "canceled")
            .otherwise("delivered")
        )
        arrived = (status == "delivered") & (key % 97 != 0)
        days_on_road = DAY * (2 + (key * 7) % 38) + (key * 131) % DAY
        return self._read("orders").select(
            _key("o_orderkey").alias("order_id"),
            F.concat(F.lit("c"), _key("o_orderkey")).alias("customer_id"),
            status.alias("order_status"),
            _after_order(0).alias("order_purchase_timestamp"),
            _after_order(key % 7200).alias("order_approved_at"),
            _after_order(DAY * (1 + key % 5)).alias("order_delivered_carrier_date"),
            F.when(arrived, _after_order(days_on_road)).alias("order_delivered_customer_date"),
            F.date_add(F.to_date("o_orderdate"), 25)
            .cast("timestamp_ntz")
            .alias("order_estimated_delivery_date"),
            key.alias(INGEST_SEQ),
        )

    def _order_items(self) -> DataFrame:
        return self._read("lineitem").select(
            _key("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            _key("l_partkey").alias("product_id"),
            _key("l_suppkey").alias("seller_id"),
            F.col("l_shipdate").alias("shipping_limit_date"),
            F.col("l_extendedprice").cast(MONEY).alias("price"),
            F.col("l_quantity").cast(MONEY).alias("freight_value"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias(INGEST_SEQ),
        )

    def _order_payments(self) -> DataFrame:
        key = F.col("o_orderkey")
        main = F.struct(
            F.lit(1).alias("payment_sequential"),
            _mapped(F.col("o_orderpriority"), PAYMENT_BY_PRIORITY).alias("payment_type"),
            (1 + key % 10).cast("int").alias("payment_installments"),
            F.col("o_totalprice").cast(MONEY).alias("payment_value"),
        )
        voucher = F.struct(
            F.lit(2).alias("payment_sequential"),
            F.lit("voucher").alias("payment_type"),
            F.lit(1).alias("payment_installments"),
            (10 + key % 90).cast(MONEY).alias("payment_value"),
        )
        payments = F.when(key % 5 == 0, F.array(main, voucher)).otherwise(F.array(main))
        return self._read("orders").select(
            _key("o_orderkey").alias("order_id"),
            F.inline(payments),
            (key * 10).alias(INGEST_SEQ),
        )

    def _order_reviews(self) -> DataFrame:
        key = F.col("o_orderkey")

        def review(prefix: str, score: Column, day: int, given: Column) -> Column:
            return F.when(
                given,
                F.struct(
                    F.concat(F.lit(prefix), _key("o_orderkey")).alias("review_id"),
                    score.cast("int").alias("review_score"),
                    _after_order(DAY * day).alias("review_creation_date"),
                ),
            )

        reviews = F.array_compact(
            F.array(
                review("r", 1 + (key * 3) % 5, 45, key % 13 != 0),
                review("q", 1 + (key + 1) % 5, 50, key % 29 == 0),
            )
        )
        return self._read("orders").select(
            _key("o_orderkey").alias("order_id"),
            F.inline(reviews),
            _null().alias("review_comment_title"),
            _null().alias("review_comment_message"),
            _null("timestamp_ntz").alias("review_answer_timestamp"),
            (key * 10).alias(INGEST_SEQ),
        )

    def _products(self) -> DataFrame:
        key = F.col("p_partkey")
        return self._read("part").select(
            _key("p_partkey").alias("product_id"),
            F.when(key % 50 != 0, F.lower("p_type")).alias("product_category_name"),
            F.length("p_name").alias("product_name_lenght"),
            _null("int").alias("product_description_lenght"),
            _null("int").alias("product_photos_qty"),
            F.col("p_retailprice").alias("product_weight_g"),
            F.col("p_size").cast("double").alias("product_length_cm"),
            (F.col("p_size") % 7 + 1).cast("double").alias("product_height_cm"),
            F.when(key % 61 != 0, (F.col("p_size") % 5 + 1).cast("double")).alias("product_width_cm"),
            key.alias(INGEST_SEQ),
        )

    def _category_translation(self) -> DataFrame:
        original = F.lower("p_type")
        return (
            self._read("part")
            .select(
                original.alias("product_category_name"),
                _mapped(original, TRANSLATION).alias("product_category_name_english"),
            )
            .filter("product_category_name_english IS NOT NULL")
            .distinct()
            .withColumn(INGEST_SEQ, F.lit(0).cast("bigint"))
        )

    def _sellers(self) -> DataFrame:
        return self._placed("supplier", "s_nationkey").select(
            _key("s_suppkey").alias("seller_id"),
            (5000 + F.col("s_suppkey") % 300).cast("int").alias("seller_zip_code_prefix"),
            F.lower("n_name").alias("seller_city"),
            F.upper("r_name").alias("seller_state"),
            F.col("s_suppkey").alias(INGEST_SEQ),
        )

    def _geolocation(self) -> DataFrame:
        def located(rows: DataFrame, key: Column, zip_code: Column) -> DataFrame:
            return rows.select(
                zip_code.cast("int").alias("geolocation_zip_code_prefix"),
                (-30 + ((key * 7919) % 2500) / 100).cast("decimal(10,4)").alias("geolocation_lat"),
                (-70 + ((key * 104729) % 3000) / 100).cast("decimal(10,4)").alias("geolocation_lng"),
                F.col("n_name").alias("geolocation_city"),
                F.col("r_name").alias("geolocation_state"),
                key.alias(INGEST_SEQ),
            )

        buyer, seller = F.col("c_custkey"), F.col("s_suppkey")
        buyers = self._placed("customer", "c_nationkey").filter(buyer % 500 != 499)
        sellers = self._placed("supplier", "s_nationkey")
        return located(buyers, buyer, 1000 + buyer % 500).union(
            located(sellers, seller, 5000 + seller % 300)
        )
