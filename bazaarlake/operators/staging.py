"""Raw datasets to typed staging tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlake.functions.casts import (
    text,
    to_degrees,
    to_double,
    to_int,
    to_money,
    to_timestamp,
)
from bazaarlake.operators.skew import HotKeys, skew_join
from bazaarlake.sources.schemas import INGEST_SEQ


def _kept_sequence(raw: DataFrame) -> list[str]:
    return [INGEST_SEQ] if INGEST_SEQ in raw.columns else []


def stg_customers(raw: DataFrame) -> DataFrame:
    return raw.select(
        text(raw, "customer_id").alias("customer_id"),
        text(raw, "customer_unique_id").alias("customer_unique_id"),
        to_int(raw, "customer_zip_code_prefix"),
        F.lower(text(raw, "customer_city")).alias("customer_city"),
        F.upper(text(raw, "customer_state")).alias("customer_state"),
    )


def stg_orders(raw: DataFrame) -> DataFrame:
    return raw.select(
        text(raw, "order_id").alias("order_id"),
        text(raw, "customer_id").alias("customer_id"),
        F.lower(text(raw, "order_status")).alias("order_status"),
        to_timestamp(raw, "order_purchase_timestamp"),
        to_timestamp(raw, "order_approved_at"),
        to_timestamp(raw, "order_delivered_carrier_date"),
        to_timestamp(raw, "order_delivered_customer_date"),
        to_timestamp(raw, "order_estimated_delivery_date"),
    )


def stg_order_items(raw: DataFrame) -> DataFrame:
    return raw.select(
        text(raw, "order_id").alias("order_id"),
        to_int(raw, "order_item_id"),
        text(raw, "product_id").alias("product_id"),
        text(raw, "seller_id").alias("seller_id"),
        to_timestamp(raw, "shipping_limit_date"),
        to_money(raw, "price"),
        to_money(raw, "freight_value"),
    )


def stg_payments(raw: DataFrame) -> DataFrame:
    return raw.select(
        text(raw, "order_id").alias("order_id"),
        to_int(raw, "payment_sequential"),
        F.lower(text(raw, "payment_type")).alias("payment_type"),
        to_int(raw, "payment_installments"),
        to_money(raw, "payment_value"),
    )


def stg_reviews(raw: DataFrame) -> DataFrame:
    return raw.select(
        text(raw, "review_id").alias("review_id"),
        text(raw, "order_id").alias("order_id"),
        to_int(raw, "review_score"),
        text(raw, "review_comment_title").alias("review_comment_title"),
        text(raw, "review_comment_message").alias("review_comment_message"),
        to_timestamp(raw, "review_creation_date"),
        to_timestamp(raw, "review_answer_timestamp"),
    )


def stg_products(raw: DataFrame, translation: DataFrame, hot_category: HotKeys) -> DataFrame:
    original = "product_category_name"
    english = "product_category_name_english"
    names = translation.select(
        text(translation, original).alias(original),
        text(translation, english).alias("_translated"),
    )
    products = raw.withColumn(original, text(raw, original))
    named = skew_join(products, names, original, hot_category)
    return named.select(
        text(raw, "product_id").alias("product_id"),
        original,
        F.coalesce("_translated", original, F.lit("unknown")).alias(english),
        to_int(raw, "product_name_lenght").alias("product_name_length"),
        to_int(raw, "product_description_lenght").alias("product_description_length"),
        to_int(raw, "product_photos_qty"),
        to_double(raw, "product_weight_g"),
        to_double(raw, "product_length_cm"),
        to_double(raw, "product_height_cm"),
        to_double(raw, "product_width_cm"),
        *_kept_sequence(raw),
    )


def stg_sellers(raw: DataFrame) -> DataFrame:
    return raw.select(
        text(raw, "seller_id").alias("seller_id"),
        to_int(raw, "seller_zip_code_prefix"),
        F.lower(text(raw, "seller_city")).alias("seller_city"),
        F.upper(text(raw, "seller_state")).alias("seller_state"),
        *_kept_sequence(raw),
    )


def stg_geolocation(raw: DataFrame) -> DataFrame:
    """One centroid per zip code."""

    def centre(name: str):
        # Exact decimal sum over the count: the same whatever the row order.
        return F.sum(name).cast("double") / F.count(name)

    points = raw.select(
        to_int(raw, "geolocation_zip_code_prefix").alias("zip_code_prefix"),
        to_degrees(raw, "geolocation_lat").alias("lat"),
        to_degrees(raw, "geolocation_lng").alias("lng"),
        text(raw, "geolocation_city").alias("city"),
        text(raw, "geolocation_state").alias("state"),
    )
    return points.groupBy("zip_code_prefix").agg(
        F.when(F.count("lat") > 0, centre("lat")).alias("latitude"),
        F.when(F.count("lng") > 0, centre("lng")).alias("longitude"),
        F.lower(F.min("city")).alias("city"),
        F.upper(F.min("state")).alias("state"),
    )
