"""DuckDB definitions of the datasets and tables, as CTEs.

Everything here joins row by row and counts distinct values the plain way, so
the Spark jobs, which aggregate per order first, are checked against a
different route to the same figures.
"""

from __future__ import annotations


def rnd(expression: str, digits: int) -> str:
    """Round half away from zero on the decimal value, as a double."""
    return f"CAST(round(CAST({expression} AS DECIMAL(38,12)), {digits}) AS DOUBLE)"


def after_order(seconds: str) -> str:
    return f"o_orderdate + to_seconds(CAST((o_orderkey * 7919) % 86400 + {seconds} AS INTEGER))"


ORDER_STATUS = """CASE WHEN o_orderstatus = 'O' AND o_orderkey % 4 = 0 THEN 'shipped'
  WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN 'canceled' ELSE 'delivered' END"""

BASE = {
    "buyers": """
SELECT c_custkey, n_name, r_name FROM customer
JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "shops": """
SELECT s_suppkey, n_name, r_name FROM supplier
JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "stg_customers": """
SELECT 'c' || o_orderkey AS customer_id, CAST(o_custkey AS VARCHAR) AS customer_unique_id,
  CAST(1000 + o_custkey % 500 AS INTEGER) AS customer_zip_code_prefix,
  lower(n_name) AS customer_city, upper(r_name) AS customer_state
FROM orders JOIN buyers ON c_custkey = o_custkey""",
    "stg_orders": f"""
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, 'c' || o_orderkey AS customer_id,
  {ORDER_STATUS} AS order_status,
  CAST({after_order("0")} AS TIMESTAMP) AS order_purchase_timestamp,
  CAST({after_order("o_orderkey % 7200")} AS TIMESTAMP) AS order_approved_at,
  CAST({after_order("86400 * (1 + o_orderkey % 5)")} AS TIMESTAMP) AS order_delivered_carrier_date,
  CASE WHEN {ORDER_STATUS} = 'delivered' AND o_orderkey % 97 <> 0 THEN CAST({after_order(
      "86400 * (2 + (o_orderkey * 7) % 38) + (o_orderkey * 131) % 86400"
  )} AS TIMESTAMP) END AS order_delivered_customer_date,
  CAST(CAST(o_orderdate AS DATE) + 25 AS TIMESTAMP) AS order_estimated_delivery_date
FROM orders""",
    "stg_order_items": """
SELECT CAST(l_orderkey AS VARCHAR) AS order_id, l_linenumber AS order_item_id,
  CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_suppkey AS VARCHAR) AS seller_id,
  l_shipdate AS shipping_limit_date, CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
  CAST(l_quantity AS DECIMAL(18,2)) AS freight_value
FROM lineitem""",
    "stg_payments": """
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, 1 AS payment_sequential,
  CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM') THEN 'credit_card'
    WHEN o_orderpriority = '2-HIGH' THEN 'boleto'
    WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'debit_card'
    WHEN o_orderpriority = '5-LOW' THEN 'voucher' END AS payment_type,
  CAST(1 + o_orderkey % 10 AS INTEGER) AS payment_installments,
  CAST(o_totalprice AS DECIMAL(18,2)) AS payment_value
FROM orders
UNION ALL
SELECT CAST(o_orderkey AS VARCHAR), 2, 'voucher', 1, CAST(10 + o_orderkey % 90 AS DECIMAL(18,2))
FROM orders WHERE o_orderkey % 5 = 0""",
    "stg_reviews": f"""
SELECT 'r' || o_orderkey AS review_id, CAST(o_orderkey AS VARCHAR) AS order_id,
  CAST(1 + (o_orderkey * 3) % 5 AS INTEGER) AS review_score,
  CAST(NULL AS VARCHAR) AS review_comment_title, CAST(NULL AS VARCHAR) AS review_comment_message,
  CAST({after_order("86400 * 45")} AS TIMESTAMP) AS review_creation_date,
  CAST(NULL AS TIMESTAMP) AS review_answer_timestamp
FROM orders WHERE o_orderkey % 13 <> 0
UNION ALL
SELECT 'q' || o_orderkey, CAST(o_orderkey AS VARCHAR), CAST(1 + (o_orderkey + 1) % 5 AS INTEGER),
  NULL, NULL, CAST({after_order("86400 * 50")} AS TIMESTAMP), NULL
FROM orders WHERE o_orderkey % 29 = 0""",
    "english": """
SELECT * FROM (VALUES ('economy', 'budget'), ('large', 'large_goods'), ('medium', 'medium_goods'),
  ('promo', 'promotions'), ('small', 'small_goods')) AS v(original, translated)""",
    "typed_parts": """
SELECT *, CASE WHEN p_partkey % 50 <> 0 THEN lower(p_type) END AS original FROM part""",
    "stg_products": """
SELECT CAST(p_partkey AS VARCHAR) AS product_id, original AS product_category_name,
  coalesce(translated, original, 'unknown') AS product_category_name_english,
  CAST(length(p_name) AS INTEGER) AS product_name_length,
  CAST(NULL AS INTEGER) AS product_description_length, CAST(NULL AS INTEGER) AS product_photos_qty,
  p_retailprice AS product_weight_g, CAST(p_size AS DOUBLE) AS product_length_cm,
  CAST(p_size % 7 + 1 AS DOUBLE) AS product_height_cm,
  CASE WHEN p_partkey % 61 <> 0 THEN CAST(p_size % 5 + 1 AS DOUBLE) END AS product_width_cm,
  p_partkey AS entered
FROM typed_parts LEFT JOIN english USING (original)""",
    "stg_sellers": """
SELECT CAST(s_suppkey AS VARCHAR) AS seller_id,
  CAST(5000 + s_suppkey % 300 AS INTEGER) AS seller_zip_code_prefix,
  lower(n_name) AS seller_city, upper(r_name) AS seller_state, s_suppkey AS entered
FROM shops""",
    "places": """
SELECT CAST(1000 + c_custkey % 500 AS INTEGER) AS zip, c_custkey AS k, n_name, r_name
FROM buyers WHERE c_custkey % 500 <> 499
UNION ALL
SELECT CAST(5000 + s_suppkey % 300 AS INTEGER), s_suppkey, n_name, r_name FROM shops""",
    "points": """
SELECT zip, n_name, r_name, CAST(-30 + ((k * 7919) % 2500) / 100.0 AS DECIMAL(10,4)) AS lat,
  CAST(-70 + ((k * 104729) % 3000) / 100.0 AS DECIMAL(10,4)) AS lng FROM places""",
    "stg_geolocation": """
SELECT zip AS zip_code_prefix, CAST(sum(lat) AS DOUBLE) / count(lat) AS latitude,
  CAST(sum(lng) AS DOUBLE) / count(lng) AS longitude,
  lower(min(n_name)) AS city, upper(min(r_name)) AS state
FROM points GROUP BY zip""",
    "dim_customers": """
SELECT b.*, g.latitude AS customer_latitude, g.longitude AS customer_longitude
FROM stg_customers AS b LEFT JOIN stg_geolocation AS g ON b.customer_zip_code_prefix = g.zip_code_prefix""",
    "dim_sellers": """
SELECT b.*, g.latitude AS seller_latitude, g.longitude AS seller_longitude
FROM stg_sellers AS b LEFT JOIN stg_geolocation AS g ON b.seller_zip_code_prefix = g.zip_code_prefix""",
    "dim_products": """
SELECT *, product_length_cm * product_height_cm * product_width_cm AS product_volume_cm3
FROM stg_products""",
    "order_facts": """
SELECT *, CAST(order_purchase_timestamp AS DATE) AS purchase_date,
  strftime(order_purchase_timestamp, '%Y-%m') AS purchase_month,
  date_diff('second', order_purchase_timestamp, order_delivered_customer_date) AS seconds,
  date_diff('second', order_purchase_timestamp, order_delivered_customer_date) / 86400e0 AS delivery_days,
  CAST(coalesce(order_delivered_customer_date > order_estimated_delivery_date, false) AS INTEGER)
    AS is_late_delivery,
  CAST(order_status = 'canceled' AS INTEGER) AS is_canceled
FROM stg_orders LEFT JOIN stg_customers USING (customer_id)""",
    "item_facts": """
SELECT stg_order_items.*, price + freight_value AS item_gmv, purchase_date, purchase_month,
  order_status, is_late_delivery, delivery_days, seconds, customer_id, customer_unique_id,
  customer_city, customer_state, customer_zip_code_prefix, order_purchase_timestamp,
  order_facts.order_id AS known_order
FROM stg_order_items LEFT JOIN order_facts USING (order_id)""",
    # One row per line and review of its order.
    "sale_rows": """
SELECT item_facts.*, product_category_name_english AS category, seller_city, seller_state,
  stg_sellers.seller_id AS known_seller, review_score
FROM item_facts
LEFT JOIN stg_products USING (product_id)
LEFT JOIN stg_sellers USING (seller_id)
LEFT JOIN stg_reviews USING (order_id)""",
    # One row per line; the score is the mean of its order's reviews.
    "order_scores": "SELECT order_id, avg(review_score) AS review_score FROM stg_reviews GROUP BY order_id",
    "single_rows": """
SELECT item_facts.*, coalesce(product_category_name_english, 'unknown') AS category,
  seller_city, seller_state, stg_sellers.seller_id AS known_seller, review_score
FROM item_facts
LEFT JOIN stg_products USING (product_id)
LEFT JOIN stg_sellers USING (seller_id)
LEFT JOIN order_scores USING (order_id)""",
    # One row per payment, line and review of the order.
    "payment_rows": """
SELECT stg_payments.*, order_facts.order_status, order_facts.order_purchase_timestamp,
  customer_city, customer_state, seller_state, product_category_name_english AS category, review_score
FROM stg_payments
LEFT JOIN order_facts USING (order_id)
LEFT JOIN stg_order_items USING (order_id)
LEFT JOIN stg_sellers USING (seller_id)
LEFT JOIN stg_products USING (product_id)
LEFT JOIN stg_reviews USING (order_id)""",
}


def with_tables(body: str, **extra: str) -> str:
    """``body`` behind the base CTEs and further ones of its own."""
    ctes = ",\n".join(f"{name} AS ({sql})" for name, sql in {**BASE, **extra}.items())
    return f"WITH {ctes}\n{body}"
