"""DuckDB SQL for every registered query."""

from __future__ import annotations

from oracle.base import rnd, with_tables

LATE_PCT = rnd(
    "CASE WHEN count(DISTINCT known_order) = 0 THEN 0e0 ELSE CAST(count(DISTINCT known_order)"
    " FILTER (is_late_delivery = 1) AS DOUBLE) * 100e0 / CAST(count(DISTINCT known_order) AS DOUBLE) END",
    2,
)
MEAN_SCORE = rnd("coalesce(avg(review_score), 0)", 2)
GMV = "CAST(coalesce(sum(item_gmv), 0) AS DOUBLE)"
DAYS = "CAST(sum(seconds) AS DOUBLE) / 86400e0 / {rows}"
FCT_ORDERS = """order_id, customer_id, customer_unique_id, order_status, purchase_date,
  order_purchase_timestamp, order_approved_at, order_delivered_carrier_date,
  order_delivered_customer_date, order_estimated_delivery_date, delivery_days, is_late_delivery,
  is_canceled"""


def doubles(table: str, *names: str, drop: str | None = None) -> str:
    replaced = ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)
    exclude = f"EXCLUDE ({drop}) " if drop else ""
    replace = f"REPLACE ({replaced}) " if names else ""
    return with_tables(f"SELECT * {exclude}{replace}FROM {table}")


# -- parameterised bodies ---------------------------------------------------


def revenue_by_category(rows: str) -> str:
    return with_tables(f"""
SELECT coalesce(category, 'unknown') AS category, count(DISTINCT order_id) AS orders,
  count(*) AS items_sold, CAST(sum(price) AS DOUBLE) AS merchandise_revenue,
  CAST(sum(freight_value) AS DOUBLE) AS freight_revenue, CAST(sum(item_gmv) AS DOUBLE) AS gmv,
  {rnd("avg(review_score)", 2)} AS avg_review_score,
  {rnd("avg(is_late_delivery)", 4)} AS late_delivery_rate
FROM {rows} GROUP BY 1""")


def seller_base(repeat: str) -> dict[str, str]:
    """CTEs ending in seller_base; ``repeat`` is '*' or '1' copies per month."""
    return {
        "by_month": """
SELECT seller_id, purchase_month, sum(item_gmv) AS gmv FROM item_facts GROUP BY ALL""",
        "growth": """
SELECT seller_id, count(*) AS months,
  arg_min(gmv, coalesce(purchase_month, '')) AS opening, arg_max(gmv, coalesce(purchase_month, '')) AS closing
FROM by_month GROUP BY seller_id""",
        "ratings": "SELECT seller_id, avg(review_score) AS score FROM sale_rows GROUP BY seller_id",
        "activity": """
SELECT seller_id, count(DISTINCT order_id) AS orders, sum(item_gmv) AS gmv,
  avg(1 - is_late_delivery) FILTER (order_status = 'delivered') AS on_time,
  avg(CASE WHEN order_status = 'canceled' THEN 1 ELSE 0 END) AS canceled
FROM item_facts GROUP BY seller_id""",
        "seller_base": f"""
SELECT activity.seller_id, seller_city, seller_state, orders,
  CAST(gmv * {repeat} AS DOUBLE) AS gmv, {rnd("on_time", 4)} AS on_time_delivery_rate,
  {rnd("coalesce(score, 0)", 2)} AS avg_review_score, {rnd("canceled", 4)} AS cancellation_rate,
  {rnd("CASE WHEN opening > 0 THEN CAST(closing - opening AS DOUBLE) / CAST(opening AS DOUBLE) ELSE 0e0 END", 4)}
    AS revenue_growth_rate
FROM activity LEFT JOIN growth USING (seller_id) LEFT JOIN ratings USING (seller_id)
LEFT JOIN stg_sellers USING (seller_id)""",
    }


def scores(repeat: str = "coalesce(months, 1)") -> dict[str, str]:
    points = (
        "100e0 * (0.4e0 * coalesce(on_time_delivery_rate, 0e0) + 0.3e0 * (avg_review_score / 5e0)"
        " + 0.2e0 * (1e0 - coalesce(cancellation_rate, 0e0))"
        " + 0.1e0 * greatest(0e0, least(1e0, (revenue_growth_rate + 1e0) / 2e0)))"
    )
    return {
        **seller_base(repeat),
        "scored": f"SELECT *, {rnd(points, 2)} AS performance_score FROM seller_base",
        "scores": """
SELECT *, CASE WHEN performance_score >= 80 THEN 'low_risk' WHEN performance_score >= 60 THEN 'watchlist'
  ELSE 'high_risk' END AS risk_tier FROM scored""",
    }


CARD = """seller_id, seller_city, seller_state, orders, gmv, performance_score, risk_tier,
  on_time_delivery_rate AS on_time_delivery_rate_40_percent,
  avg_review_score AS average_review_score_30_percent,
  cancellation_rate AS order_cancellation_rate_20_percent,
  revenue_growth_rate AS average_order_value_growth_10_percent,
  CASE risk_tier
    WHEN 'high_risk' THEN 'Audit fulfillment process, shipping promise, and product quality before increasing seller exposure.'
    WHEN 'watchlist' THEN 'Monitor late deliveries and review trend weekly; offer operational coaching.'
    ELSE 'Seller is healthy; consider higher marketplace visibility.' END AS recommendation"""


def lanes(timed: str = "count(*)") -> dict[str, str]:
    # Distance of every line, then the lane's mean: the row-by-row route.
    half = "pow(sin(radians({b} - {a}) / 2), 2)"
    lat = half.format(a="s.seller_latitude", b="c.customer_latitude")
    lng = half.format(a="s.seller_longitude", b="c.customer_longitude")
    chord = f"{lat} + cos(radians(s.seller_latitude)) * cos(radians(c.customer_latitude)) * {lng}"
    return {
        "shipped_lines": f"""
SELECT s.seller_zip_code_prefix AS origin_zip, c.customer_zip_code_prefix AS destination_zip,
  seconds, is_late_delivery, 12742e0 * asin(sqrt({chord})) AS km
FROM item_facts AS i JOIN dim_sellers AS s ON s.seller_id = i.seller_id
JOIN dim_customers AS c ON c.customer_id = i.customer_id WHERE order_status = 'delivered'""",
        "lanes": f"""
SELECT origin_zip, destination_zip, count(*) AS orders,
  {rnd(f"CASE WHEN {timed} > 0 THEN CAST(coalesce(sum(seconds), 0) AS DOUBLE) / 86400e0 / {timed} END", 2)}
    AS avg_delivery_days,
  {rnd("CAST(sum(is_late_delivery) AS DOUBLE) / count(*)", 4)} AS late_delivery_rate,
  {rnd("avg(km)", 2)} AS avg_distance_km
FROM shipped_lines GROUP BY 1, 2""",
    }


RFM = {
    "spenders": """
SELECT customer_unique_id, max(purchase_date) AS latest, count(DISTINCT order_id) AS frequency,
  CAST(coalesce(sum(item_gmv), 0) AS DOUBLE) AS monetary
FROM item_facts WHERE order_status = 'delivered' AND purchase_date IS NOT NULL GROUP BY 1""",
    "aged": """
SELECT customer_unique_id, date_diff('day', latest, (SELECT max(purchase_date) FROM order_facts))
    AS recency_days, frequency, monetary FROM spenders""",
    "rfm": """
SELECT *, CASE WHEN frequency >= 3 AND monetary >= 500 THEN 'champions' WHEN frequency >= 2 THEN 'loyal'
  WHEN recency_days <= 90 THEN 'recent' WHEN recency_days > 365 THEN 'at_risk'
  ELSE 'needs_attention' END AS rfm_segment FROM aged""",
}

COHORTS = {
    "active_months": """
SELECT DISTINCT coalesce(customer_unique_id, chr(1)) AS customer_unique_id,
  date_trunc('month', purchase_date) AS active
FROM order_facts WHERE order_status = 'delivered' AND purchase_date IS NOT NULL""",
    "joined": "SELECT customer_unique_id, min(active) AS first_month FROM active_months GROUP BY 1",
    "sizes": "SELECT first_month, count(*) AS people FROM joined GROUP BY 1",
    "cohorts": f"""
SELECT strftime(first_month, '%Y-%m') AS cohort_month,
  CAST(date_diff('month', first_month, active) AS INTEGER) AS month_number,
  count(DISTINCT customer_unique_id) AS customers, any_value(people) AS cohort_size,
  {rnd("CAST(count(DISTINCT customer_unique_id) AS DOUBLE) / any_value(people)", 4)} AS retention_rate
FROM active_months JOIN joined USING (customer_unique_id) JOIN sizes USING (first_month)
GROUP BY first_month, active""",
}


def summary_select(rows: str, where: str = "true", compat: bool = True) -> str:
    units = "count(item_gmv)" if compat else "count(DISTINCT known_order)"
    average = f"CASE WHEN {units} = 0 THEN 0e0 ELSE CAST(sum(item_gmv) AS DOUBLE) / {units} END"
    return f"""
SELECT {GMV} AS total_gmv,
  count(DISTINCT known_order) FILTER (order_status = 'delivered') AS delivered_orders,
  count(DISTINCT seller_id) FILTER (order_status = 'delivered') AS active_sellers,
  count(DISTINCT customer_id) FILTER (order_status = 'delivered') AS active_customers,
  {rnd(average, 2)} AS avg_order_value, {MEAN_SCORE} AS avg_review_score,
  {LATE_PCT} AS late_delivery_rate
FROM {rows} WHERE {where}"""


def summary(rows: str = "sale_rows", where: str = "true", compat: bool = True) -> str:
    return with_tables(summary_select(rows, where, compat))


MAP_COMPAT = f"""
SELECT coalesce(customer_city, 'unknown') AS city, coalesce(customer_state, 'unknown') AS state,
  count(DISTINCT known_order) AS orders, {GMV} AS gmv, {MEAN_SCORE} AS avg_review_score,
  {LATE_PCT} AS late_delivery_pct, coalesce(category, 'unknown') AS top_category
FROM sale_rows WHERE {{where}} GROUP BY customer_city, customer_state, category
ORDER BY gmv DESC, customer_city NULLS FIRST, customer_state NULLS FIRST, category NULLS FIRST LIMIT 200"""

MAP_EXACT = f"""
SELECT coalesce(customer_city, 'unknown') AS city, coalesce(customer_state, 'unknown') AS state,
  count(DISTINCT known_order) AS orders, {GMV} AS gmv, {MEAN_SCORE} AS avg_review_score,
  {LATE_PCT} AS late_delivery_pct, any_value(best) AS top_category
FROM single_rows JOIN (
  SELECT customer_city, customer_state, category AS best FROM single_rows
  GROUP BY customer_city, customer_state, category
  QUALIFY row_number() OVER (PARTITION BY customer_city, customer_state
    ORDER BY sum(item_gmv) DESC, category) = 1
) USING (customer_city, customer_state)
GROUP BY customer_city, customer_state ORDER BY gmv DESC, customer_city, customer_state LIMIT 200"""


def categories(rows: str, where: str = "true", limit: int = 10) -> str:
    return with_tables(f"""
SELECT coalesce(category, 'unknown') AS category, {GMV} AS gmv, count(DISTINCT order_id) AS orders,
  {MEAN_SCORE} AS avg_review_score
FROM {rows} WHERE {where} GROUP BY {rows}.category
ORDER BY gmv DESC, {rows}.category NULLS FIRST LIMIT {limit}""")


def trend(rows: str, where: str = "true") -> str:
    return with_tables(f"""
SELECT purchase_month AS month, {GMV} AS gmv FROM {rows} WHERE {where} GROUP BY 1""")


def payments(rows: str, where: str = "true") -> str:
    return with_tables(f"""
SELECT payment_type, count(*) AS total, CAST(coalesce(sum(payment_value), 0) AS DOUBLE) AS total_value
FROM {rows} WHERE {where} GROUP BY payment_type""")


def leaderboard(rows: str, where: str = "true", extra: str = "") -> str:
    days = f"CASE WHEN count(seconds) > 0 THEN {DAYS.format(rows='count(seconds)')} ELSE 0e0 END"
    return with_tables(
        f"SELECT *{extra} FROM board",
        board=f"""
SELECT seller_id, seller_city, seller_state,
  count(DISTINCT known_order) FILTER (order_status = 'delivered') AS delivered_orders,
  {GMV} AS total_gmv, {MEAN_SCORE} AS avg_review_score, {LATE_PCT} AS late_delivery_pct,
  {rnd(days, 2)} AS avg_delivery_days
FROM {rows} WHERE known_seller IS NOT NULL AND {where} GROUP BY seller_id, seller_city, seller_state
HAVING count(DISTINCT known_order) FILTER (order_status = 'delivered') > 0
ORDER BY avg_review_score DESC, total_gmv DESC, seller_id LIMIT 50""",
    )


def best_category(rows: str) -> str:
    return with_tables(f"""
SELECT coalesce(t.category, 'unknown') AS category, {GMV} AS gmv FROM {rows} AS t
GROUP BY t.category ORDER BY gmv DESC, t.category NULLS FIRST LIMIT 1""")


def top_payment(rows: str) -> str:
    return with_tables(f"""
SELECT payment_type, count(*) AS total FROM {rows} GROUP BY 1 ORDER BY total DESC, payment_type LIMIT 1""")


def top_rated(rows: str) -> str:
    return with_tables(
        "SELECT seller_city, seller_state, avg_review_score FROM rated",
        rated=f"""
SELECT seller_id, any_value(seller_city) AS seller_city, any_value(seller_state) AS seller_state,
  {MEAN_SCORE} AS avg_review_score
FROM {rows} WHERE known_seller IS NOT NULL GROUP BY seller_id HAVING count(DISTINCT known_order) > 10
ORDER BY avg_review_score DESC, seller_id LIMIT 1""",
    )


LINE_ROWS = """(SELECT item_facts.*, product_category_name_english AS category, seller_city, seller_state
  FROM item_facts LEFT JOIN stg_products USING (product_id) LEFT JOIN stg_sellers USING (seller_id))"""


def sums_by(keys: str, alias: str = "gmv", where: str = "true") -> str:
    return f"SELECT {keys}, {GMV} AS {alias} FROM {LINE_ROWS} WHERE {where} GROUP BY ALL"


def late_rate(key: str, name: str) -> str:
    return with_tables(f"""
SELECT {key} AS {name}, count(DISTINCT known_order) AS orders,
  {rnd("CAST(count(DISTINCT known_order) FILTER (is_late_delivery = 1) AS DOUBLE) / count(DISTINCT known_order)", 4)}
    AS late_delivery_rate
FROM {LINE_ROWS} GROUP BY 1""")


def momentum(key: str, name: str) -> str:
    latest = "(SELECT max(date_trunc('month', purchase_date)) FROM order_facts)"
    now = "coalesce(sum(item_gmv) FILTER (age = 0), 0)"
    before = "coalesce(sum(item_gmv) FILTER (age = 1), 0)"
    change = f"CASE WHEN {before} <> 0 THEN CAST(({now} - {before}) * 100 AS DOUBLE) / CAST({before} AS DOUBLE) END"
    return with_tables(f"""
SELECT {key} AS {name}, CAST({now} AS DOUBLE) AS latest_gmv, CAST({before} AS DOUBLE) AS previous_gmv,
  CAST({now} - {before} AS DOUBLE) AS gmv_change, {rnd(change, 2)} AS change_pct
FROM (SELECT *, date_diff('month', purchase_date, {latest}) AS age FROM {LINE_ROWS})
WHERE age IN (0, 1) GROUP BY 1""")


def impact() -> str:
    cut = "(SELECT max(purchase_month) FROM order_facts)"
    names = [
        "total_gmv", "delivered_orders", "active_sellers", "active_customers", "avg_order_value",
        "avg_review_score", "late_delivery_rate",
    ]
    long = " UNION ALL ".join(
        f"SELECT '{n}' AS measure, CAST(b.{n} AS DOUBLE) AS before, CAST(a.{n} AS DOUBLE) AS after"
        " FROM earlier AS b, later AS a" for n in names
    )
    return with_tables(
        f"SELECT *, {rnd('after - before', 4)} AS change FROM ({long})",
        earlier=summary_select("sale_rows", f"purchase_month < {cut}"),
        later=summary_select("sale_rows"),
    )


REPEAT = """
SELECT customer_city, order_type, count(customer_unique_id) AS repeat_customers,
  CAST(sum(n) AS BIGINT) AS repeat_orders, CAST(sum(gmv) AS DOUBLE) AS gmv,
  {average} AS avg_repeat_orders_per_customer
FROM (
  SELECT customer_city, coalesce(category, 'unknown') AS order_type, customer_unique_id,
    count(DISTINCT order_id) AS n, sum(item_gmv) AS gmv
  FROM {rows} WHERE order_status = 'delivered' AND {where} GROUP BY ALL
  HAVING count(DISTINCT order_id) >= 2
)
GROUP BY ALL
ORDER BY repeat_orders DESC, repeat_customers DESC, gmv DESC, customer_city, order_type LIMIT 20"""


def repeat(where: str = "true") -> str:
    average = rnd("CAST(sum(n) AS DOUBLE) / count(*)", 2)
    return with_tables(REPEAT.format(average=average, rows=LINE_ROWS, where=where))


FISCAL_1997 = "order_purchase_timestamp >= TIMESTAMP '1997-04-01' AND order_purchase_timestamp < TIMESTAMP '1998-04-01'"
VOUCHER_ORDERS = "order_id IN (SELECT order_id FROM stg_payments WHERE payment_type = 'voucher')"
EVERY_FILTER = f"""{FISCAL_1997} AND month(order_purchase_timestamp) BETWEEN 7 AND 9
  AND month(order_purchase_timestamp) = 8 AND customer_state = 'ASIA' AND seller_state = 'EUROPE'
  AND category = 'budget' AND order_status = 'delivered' AND review_score = 4
  AND {VOUCHER_ORDERS}"""


def dq(value: str) -> str:
    return with_tables(f"SELECT {value} AS value")


DUPLICATES = "(SELECT count(*) - count(DISTINCT {key}) FROM {table})"
ORPHANS = "(SELECT count(*) FROM {child} WHERE NOT EXISTS (SELECT 1 FROM {parent} WHERE {parent}.{key} = {child}.{key}))"
CHECKS = {
    "orders_have_unique_ids": DUPLICATES.format(key="order_id", table="stg_orders"),
    "customers_have_unique_ids": DUPLICATES.format(key="customer_id", table="stg_customers"),
    "order_items_have_orders": ORPHANS.format(child="stg_order_items", parent="stg_orders", key="order_id"),
    "orders_have_customers": ORPHANS.format(child="stg_orders", parent="stg_customers", key="customer_id"),
    "payments_are_non_negative": "(SELECT count(*) FROM stg_payments WHERE payment_value < 0)",
}


def dq_report() -> str:
    rows = " UNION ALL ".join(f"SELECT '{name}' AS check, {sql} AS value" for name, sql in CHECKS.items())
    return with_tables(f"SELECT *, CASE WHEN value = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ({rows})")


def dq_not_null() -> str:
    tables = [
        ("stg_orders", "stg_orders", "order_id"),
        ("stg_orders", "stg_orders", "customer_id"),
        ("stg_customers", "stg_customers", "customer_id"),
        ("fct_orders", "order_facts", "order_id"),
        ("fct_order_items", "item_facts", "order_id"),
        ("dim_products", "dim_products", "product_id"),
    ]
    return with_tables(" UNION ALL ".join(
        f"SELECT '{shown}' AS \"table\", '{column}' AS \"column\", count(*) FILTER ({column} IS NULL) AS nulls"
        f" FROM {table}" for shown, table, column in tables
    ))


def dq_unique() -> str:
    tables = [
        ("stg_orders", "stg_orders", "order_id"),
        ("stg_customers", "stg_customers", "customer_id"),
        ("fct_orders", "order_facts", "order_id"),
        ("dim_products", "dim_products", "product_id"),
    ]
    return with_tables(" UNION ALL ".join(
        f"SELECT '{shown}' AS \"table\", '{column}' AS \"column\", count(*) AS duplicates FROM"
        f" (SELECT {column} FROM {table} WHERE {column} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"
        for shown, table, column in tables
    ))


def dq_relationships() -> str:
    return with_tables("""
SELECT 'orders_to_customers' AS relationship, count(*) AS orphans FROM order_facts
WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT customer_id FROM stg_customers)
UNION ALL
SELECT 'items_to_sellers', count(*) FROM item_facts
WHERE seller_id IS NOT NULL AND seller_id NOT IN (SELECT seller_id FROM stg_sellers)""")


RAW_COUNTS = """
SELECT 'customers' AS dataset, (SELECT count(*) FROM stg_customers) AS rows
UNION ALL SELECT 'orders', (SELECT count(*) FROM stg_orders)
UNION ALL SELECT 'order_items', (SELECT count(*) FROM stg_order_items)
UNION ALL SELECT 'order_payments', (SELECT count(*) FROM stg_payments)
UNION ALL SELECT 'order_reviews', (SELECT count(*) FROM stg_reviews)
UNION ALL SELECT 'products', (SELECT count(*) FROM stg_products)
UNION ALL SELECT 'sellers', (SELECT count(*) FROM stg_sellers)
UNION ALL SELECT 'geolocation', (SELECT count(*) FROM points)
UNION ALL SELECT 'category_translation', (SELECT count(*) FROM english WHERE original IN (SELECT lower(p_type) FROM part))"""

SLA = f"""
SELECT seller_state, customer_state, count(DISTINCT order_id) AS orders,
  {rnd(DAYS.format(rows="count(seconds)"), 2)} AS avg_delivery_days,
  {rnd("avg(is_late_delivery)", 4)} AS late_delivery_rate, CAST(sum(item_gmv) AS DOUBLE) AS gmv
FROM {LINE_ROWS} WHERE order_status = 'delivered' GROUP BY 1, 2"""

DATES = """
SELECT strftime(d, '%Y-%m-%d') AS date_day, strftime(d, '%Y') AS year, strftime(d, '%m') AS month,
  strftime(d, '%Y-%m') AS year_month, strftime(d, '%w') AS day_of_week
FROM (SELECT unnest(generate_series(
  (SELECT CAST(CAST(min(order_purchase_timestamp) AS DATE) AS TIMESTAMP) FROM stg_orders),
  (SELECT CAST(CAST(max(order_estimated_delivery_date) AS DATE) AS TIMESTAMP) FROM stg_orders),
  INTERVAL 1 DAY)) AS d)"""

GROWTH = f"""
SELECT purchase_month AS month, CAST(total AS DOUBLE) AS gmv, CAST(prior AS DOUBLE) AS prior_month_gmv,
  {rnd("CASE WHEN prior <> 0 THEN CAST((total - prior) * 100 AS DOUBLE) / CAST(prior AS DOUBLE) END", 2)} AS growth_pct
FROM totals LEFT JOIN (SELECT first_day + INTERVAL 1 MONTH AS first_day, total AS prior FROM totals)
  USING (first_day)"""
TOTALS = """
SELECT purchase_month, date_trunc('month', purchase_date) + INTERVAL 0 DAY AS first_day, sum(item_gmv) AS total
FROM item_facts GROUP BY ALL"""

MAP_LAYER = f"""
SELECT m.*, {rnd("least(sqrt(gmv / 500e0) * 3e0, 50e0)", 6)} AS bubble_radius,
  CASE WHEN avg_review_score >= 4 THEN '#16A34A' WHEN avg_review_score >= 3 THEN '#F59E0B' ELSE '#DC2626' END
    AS review_color, latitude, longitude
FROM sales AS m LEFT JOIN (
  SELECT customer_city AS city, customer_state AS state,
    {rnd("CAST(sum(CAST(customer_latitude AS DECIMAL(18,9))) AS DOUBLE) / count(customer_latitude)", 6)} AS latitude,
    {rnd("CAST(sum(CAST(customer_longitude AS DECIMAL(18,9))) AS DOUBLE) / count(customer_longitude)", 6)} AS longitude
  FROM dim_customers GROUP BY 1, 2
) AS p ON p.city IS NOT DISTINCT FROM m.city AND p.state IS NOT DISTINCT FROM m.state"""

MEASURES = f"""
SELECT (SELECT CAST(sum(item_gmv) AS DOUBLE) FROM item_facts) AS total_gmv,
  (SELECT count(DISTINCT order_id) FROM order_facts WHERE order_status = 'delivered') AS delivered_orders,
  (SELECT count(DISTINCT seller_id) FROM item_facts) AS active_sellers,
  (SELECT {rnd("avg(review_score)", 2)} FROM stg_reviews) AS avg_review_score,
  (SELECT {rnd("CAST(count(DISTINCT order_id) FILTER (is_late_delivery = 1) AS DOUBLE) / count(DISTINCT order_id)", 4)}
    FROM order_facts) AS late_delivery_rate"""


def top(keys: str, where: str = "true") -> str:
    first = keys.split(",")[0]
    return with_tables(f"{sums_by(keys, where=where)} ORDER BY gmv DESC, {first} NULLS FIRST LIMIT 10")


def heatmap(months: int = 80) -> str:
    columns = ", ".join(
        f"max(retention_rate) FILTER (month_number = {n}) AS month_{n}" for n in range(months)
    )
    return with_tables(f"SELECT cohort_month, {columns} FROM cohorts GROUP BY 1", **COHORTS)


def oracle_sql() -> dict[str, str]:
    exact_scores = scores("1")
    return {
        # sources
        "raw_row_counts": with_tables(RAW_COUNTS),
        "dataset_sample": with_tables("""
SELECT * FROM stg_orders ORDER BY CAST(order_id AS BIGINT) LIMIT 5"""),
        # staging
        "stg_customers": doubles("stg_customers"),
        "stg_orders": doubles("stg_orders"),
        "stg_order_items": doubles("stg_order_items", "price", "freight_value"),
        "stg_payments": doubles("stg_payments", "payment_value"),
        "stg_reviews": doubles("stg_reviews"),
        "stg_products": doubles("stg_products", drop="entered"),
        "stg_sellers": doubles("stg_sellers", drop="entered"),
        "stg_geolocation": doubles("stg_geolocation"),
        "stg_orders_dbt": doubles("stg_orders", drop="order_delivered_carrier_date"),
        # dimensions and facts
        "dim_customers": doubles("dim_customers"),
        "dim_sellers": doubles("dim_sellers", drop="entered"),
        "dim_products": doubles("dim_products", drop="entered"),
        "dim_dates": with_tables(DATES),
        "fct_orders": with_tables(f"SELECT {FCT_ORDERS} FROM order_facts"),
        "fct_order_items": with_tables("""
SELECT order_id, order_item_id, product_id, seller_id, shipping_limit_date, CAST(price AS DOUBLE) AS price,
  CAST(freight_value AS DOUBLE) AS freight_value, CAST(item_gmv AS DOUBLE) AS item_gmv, purchase_date,
  order_status, is_late_delivery, delivery_days FROM item_facts"""),
        "fct_payments": doubles("stg_payments", "payment_value"),
        "fct_orders_dbt": with_tables("""
SELECT order_id, customer_id, order_status, purchase_date, order_purchase_timestamp,
  order_delivered_customer_date, order_estimated_delivery_date,
  CAST(trunc(seconds / 86400e0) AS INTEGER) AS delivery_days, is_late_delivery FROM order_facts"""),
        # filters
        "filter_financial_year": summary(where=FISCAL_1997),
        "filter_fiscal_quarter": categories("sale_rows", "month(order_purchase_timestamp) <= 3"),
        "filter_month": leaderboard("sale_rows", "month(order_purchase_timestamp) = 12"),
        "filter_customer_state": trend("sale_rows", "customer_state = 'ASIA'"),
        "filter_customer_city": categories("sale_rows", "customer_city = 'nation_3'"),
        "filter_seller_state": summary(where="seller_state = 'EUROPE'"),
        "filter_product_category": payments("payment_rows", "category = 'budget'"),
        "filter_payment_type": summary(where=VOUCHER_ORDERS),
        "filter_order_status": trend("sale_rows", "order_status = 'canceled'"),
        "filter_review_score": trend("sale_rows", "review_score = 5"),
        "filter_everything": summary(where=EVERY_FILTER),
        # views and reports
        "revenue_by_category": revenue_by_category("sale_rows"),
        "revenue_by_category_exact": revenue_by_category("single_rows"),
        "delivery_sla_by_state": with_tables(SLA),
        "seller_performance_base": with_tables(
            "SELECT * FROM seller_base", **seller_base("coalesce(months, 1)")
        ),
        "seller_performance_base_exact": with_tables("SELECT * FROM seller_base", **seller_base("1")),
        "seller_scores": with_tables("SELECT * FROM scores", **scores()),
        "seller_scores_exact": with_tables("SELECT * FROM scores", **exact_scores),
        "customer_rfm": with_tables("SELECT * FROM rfm", **RFM),
        "cohort_retention": with_tables("SELECT * FROM cohorts", **COHORTS),
        "delivery_lanes": with_tables("SELECT * FROM lanes", **lanes()),
        "delivery_lanes_exact": with_tables("SELECT * FROM lanes", **lanes("count(seconds)")),
        # lookups and rankings
        "orders_recent": with_tables(f"""
SELECT {FCT_ORDERS} FROM order_facts ORDER BY order_purchase_timestamp DESC NULLS LAST, order_id LIMIT 10"""),
        "products_recent": with_tables(
            "SELECT * EXCLUDE (entered) FROM dim_products ORDER BY entered DESC LIMIT 10"
        ),
        "sellers_recent": with_tables(
            "SELECT * EXCLUDE (entered) FROM dim_sellers ORDER BY entered DESC LIMIT 10"
        ),
        "order_by_id": with_tables(f"SELECT {FCT_ORDERS} FROM order_facts WHERE order_id = '7'"),
        "product_by_id": with_tables(
            "SELECT * EXCLUDE (entered) FROM dim_products WHERE product_id = '7'"
        ),
        "seller_score_lookup": with_tables(
            f"SELECT {CARD} FROM scores WHERE seller_id = '7'", **scores()
        ),
        "seller_score_leaderboard": with_tables(
            f"""
SELECT row_number() OVER (ORDER BY performance_score DESC, seller_id) AS rank, {CARD},
  count(*) OVER () AS total_matching_sellers, least(10, count(*) OVER ()) AS count_returned
FROM scores WHERE orders >= 1 QUALIFY rank <= 10""",
            **scores(),
        ),
        "seller_detail": with_tables(
            f"""
SELECT * FROM (SELECT row_number() OVER (ORDER BY performance_score DESC, seller_id) AS rank, {CARD}
  FROM scores) WHERE seller_id = '7'""",
            **scores(),
        ),
        "repeat_orders_by_city": repeat(),
        "repeat_orders_in_one_city": repeat("customer_city = 'nation_3'"),
        "delivery_estimate": with_tables(
            """
SELECT origin_zip, destination_zip, CAST(ceil(avg_delivery_days) AS BIGINT) AS estimated_delivery_days,
  late_delivery_rate, orders AS historical_orders, 'exact historical lane' AS method
FROM lanes WHERE origin_zip = 5000 AND destination_zip = 1003""",
            **lanes(),
        ),
        # sales figures
        "sales_summary": summary(),
        "sales_summary_exact": summary("single_rows", compat=False),
        "sales_map": with_tables(MAP_COMPAT.format(where="true")),
        "sales_map_exact": with_tables(MAP_EXACT),
        "sales_categories": categories("sale_rows"),
        "sales_categories_exact": categories("single_rows"),
        "sales_trend": trend("sale_rows"),
        "sales_trend_exact": trend("single_rows"),
        "sales_payments": payments("payment_rows"),
        "sales_payments_exact": payments("stg_payments"),
        "sales_seller_leaderboard": leaderboard("sale_rows"),
        "sales_seller_leaderboard_exact": leaderboard("single_rows"),
        "insight_best_category": best_category(LINE_ROWS),
        "insight_best_category_exact": best_category("single_rows"),
        "insight_top_city": with_tables(f"""
SELECT coalesce(customer_city, 'unknown') AS city, coalesce(customer_state, 'unknown') AS state, {GMV} AS gmv
FROM item_facts GROUP BY customer_city, customer_state
ORDER BY gmv DESC, customer_city NULLS FIRST, customer_state NULLS FIRST LIMIT 1"""),
        "insight_top_payment": top_payment("payment_rows"),
        "insight_top_payment_exact": top_payment("stg_payments"),
        "insight_top_rated_seller": top_rated("sale_rows"),
        "insight_top_rated_seller_exact": top_rated("single_rows"),
        "filter_financial_year_options": with_tables("""
SELECT 'All Years' AS financial_year UNION ALL
SELECT DISTINCT year(purchase_date) || '-' || (year(purchase_date) + 1) FROM order_facts"""),
        "filter_states": with_tables("""
SELECT customer_state AS state FROM stg_customers UNION SELECT seller_state FROM stg_sellers"""),
        "filter_categories": with_tables(
            "SELECT DISTINCT product_category_name_english AS category FROM stg_products"
        ),
        "filter_payment_types": with_tables("SELECT DISTINCT payment_type FROM stg_payments"),
        "map_layer": with_tables(MAP_LAYER, sales=MAP_COMPAT.format(where="true")),
        "kpi_bands": with_tables(
            """
SELECT *, CASE WHEN avg_review_score >= 4.5 THEN 'Excellent' WHEN avg_review_score >= 3.5 THEN 'Good'
  ELSE 'Needs Attention' END AS review_band,
  CASE WHEN late_delivery_rate <= 10 THEN 'On Track' ELSE 'At Risk' END AS late_band FROM headline""",
            headline=summary_select("sale_rows"),
        ),
        "seller_bands": leaderboard(
            "sale_rows",
            extra=""", CASE WHEN avg_review_score >= 4.5 THEN '#16A34A' WHEN avg_review_score >= 3.5
  THEN '#F59E0B' ELSE '#DC2626' END AS review_color, CASE WHEN late_delivery_pct <= 10 THEN '#16A34A'
  WHEN late_delivery_pct <= 20 THEN '#F59E0B' ELSE '#DC2626' END AS late_color""",
        ),
        # measures
        "measures": with_tables(MEASURES),
        "gmv_by_city": with_tables(sums_by("customer_city")),
        "orders_by_city": with_tables("""
SELECT customer_city, count(DISTINCT order_id) AS orders FROM order_facts GROUP BY 1"""),
        "monthly_gmv_growth": with_tables(GROWTH, totals=TOTALS),
        "top_cities": top("customer_city"),
        "top_states": top("customer_state"),
        "top_sellers_by_gmv": top("seller_id, seller_city, seller_state", "seller_id IS NOT NULL"),
        "late_rate_by_seller_state": late_rate("seller_state", "seller_state"),
        "late_rate_by_category": late_rate("coalesce(category, 'unknown')", "category"),
        "seller_tier_distribution": with_tables(
            "SELECT risk_tier, count(*) AS sellers FROM scores GROUP BY 1", **scores()
        ),
        "state_lanes": with_tables("SELECT * EXCLUDE (gmv) FROM sla", sla=SLA),
        "distance_vs_days": with_tables(
            """
SELECT origin_zip, destination_zip, avg_distance_km, avg_delivery_days, orders FROM lanes
WHERE avg_distance_km IS NOT NULL""",
            **lanes(),
        ),
        "cohort_heatmap": heatmap(),
        "rfm_distribution": with_tables(
            """
SELECT rfm_segment, count(*) AS customers, CAST(sum(CAST(monetary AS DECIMAL(28,2))) AS DOUBLE) AS monetary
FROM rfm GROUP BY 1""",
            **RFM,
        ),
        "monetary_by_state_category": with_tables(
            sums_by("customer_state, coalesce(category, 'unknown') AS category", "monetary",
                    "order_status = 'delivered'")
        ),
        "city_momentum": momentum("customer_city", "customer_city"),
        "category_momentum": momentum("coalesce(category, 'unknown')", "category"),
        "seller_momentum": momentum("seller_id", "seller_id"),
        "ingest_impact": impact(),
        # quality
        "dq_orders_unique": dq(CHECKS["orders_have_unique_ids"]),
        "dq_customers_unique": dq(CHECKS["customers_have_unique_ids"]),
        "dq_items_have_orders": dq(CHECKS["order_items_have_orders"]),
        "dq_orders_have_customers": dq(CHECKS["orders_have_customers"]),
        "dq_payments_non_negative": dq(CHECKS["payments_are_non_negative"]),
        "dq_report": dq_report(),
        "dq_not_null": dq_not_null(),
        "dq_unique": dq_unique(),
        "dq_relationships": dq_relationships(),
    }
