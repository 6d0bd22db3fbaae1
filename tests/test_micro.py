"""Edge cases on hand-made rows, with answers worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

import micro
from bazaarlake.functions import numeric
from bazaarlake.operators.filters import SalesFilter
from bazaarlake.plans import (
    display,
    features,
    measures,
    options,
    orders,
    quality,
    sales,
    sellers,
    views,
)
from bazaarlake.operators.facts import fct_orders_warehouse_variant
from bazaarlake.plans.warehouse import published


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def by(df, key):
    return {row[key]: row for row in df.collect()}


# -- staging ----------------------------------------------------------------


def test_dirty_text_is_cast_leniently(spark):
    wh = micro.warehouse(
        spark,
        customers=micro.rows(
            "customers",
            *[
                {"customer_id": f"c{i}", "customer_zip_code_prefix": zip_code}
                for i, zip_code in enumerate(["", "12abc", "40.7", None, "01151"])
            ],
        ),
        orders=micro.rows(
            "orders",
            {"order_purchase_timestamp": "02/10/2017", "order_approved_at": "",
             "order_delivered_carrier_date": "2018-01-12 01:02:03.999"},
        ),
        order_items=micro.rows("order_items", {"price": "abc", "freight_value": "1.005"}),
    )
    zips = by(published(wh.table("stg_customers")), "customer_id")
    assert [zips[f"c{i}"]["customer_zip_code_prefix"] for i in range(5)] == [None, None, 40, None, 1151]
    assert zips["c0"]["customer_city"] == "campinas" and zips["c0"]["customer_state"] == "SP"
    order = one(published(wh.table("stg_orders")))
    assert order["order_purchase_timestamp"] is None and order["order_approved_at"] is None
    assert order["order_delivered_carrier_date"] == datetime.datetime(2018, 1, 12, 1, 2, 3)
    assert order["order_status"] == "delivered"
    item = one(published(wh.table("stg_order_items")))
    assert item["price"] is None and item["freight_value"] == 1.01
    assert one(published(wh.table("fct_order_items")))["item_gmv"] is None


def test_products_and_centroids(spark):
    wh = micro.warehouse(
        spark,
        products=micro.rows(
            "products",
            {"product_id": "a"},
            {"product_id": "b", "product_category_name": "livros", "product_width_cm": ""},
            {"product_id": "c", "product_category_name": ""},
        ),
        geolocation=micro.rows(
            "geolocation",
            {"geolocation_lat": "-20"},
            {"geolocation_lat": "-21", "geolocation_city": "Atibaia"},
            {"geolocation_zip_code_prefix": "01152", "geolocation_lat": ""},
        ),
    )
    products = by(published(wh.table("dim_products")), "product_id")
    assert products["a"]["product_category_name_english"] == "flowers"
    assert products["b"]["product_category_name_english"] == "livros"
    assert products["c"]["product_category_name_english"] == "unknown"
    assert products["a"]["product_volume_cm3"] == 24 and products["b"]["product_volume_cm3"] is None
    zips = by(wh.table("stg_geolocation"), "zip_code_prefix")
    assert zips[1151]["latitude"] == -20.5 and zips[1151]["city"] == "atibaia"
    assert zips[1152]["latitude"] is None and zips[1152]["state"] == "SP"
    assert one(wh.table("dim_customers"))["customer_latitude"] == -20.5


def test_lateness_is_strict(spark):
    def order(key, arrived):
        return {"order_id": key, "order_estimated_delivery_date": "2018-02-01 00:00:00",
                "order_delivered_customer_date": arrived}

    wh = micro.warehouse(
        spark,
        orders=micro.rows(
            "orders",
            order("before", "2018-01-31 23:59:59"),
            order("at", "2018-02-01 00:00:00"),
            order("after", "2018-02-01 00:00:01"),
            order("never", ""),
        ),
    )
    facts = by(wh.table("fct_orders"), "order_id")
    assert {k: r["is_late_delivery"] for k, r in facts.items()} == {
        "before": 0, "at": 0, "after": 1, "never": 0
    }
    assert facts["never"]["delivery_days"] is None
    assert facts["at"]["delivery_days"] == pytest.approx(21 + 14 / 24)
    whole = by(fct_orders_warehouse_variant(wh.table("stg_orders")), "order_id")
    assert whole["at"]["delivery_days"] == 21 and whole["never"]["delivery_days"] is None


def test_calendar(spark):
    wh = micro.warehouse(spark, orders=micro.rows("orders", {}))
    days = wh.table("dim_dates").collect()
    assert len(days) == 23
    assert days[0]["date_day"] == "2018-01-10" and days[0]["day_of_week"] == "3"
    backwards = micro.warehouse(
        spark, orders=micro.rows("orders", {"order_estimated_delivery_date": "2018-01-01 00:00:00"})
    )
    assert one(backwards.table("dim_dates"))["date_day"] == "2018-01-10"
    empty = micro.warehouse(spark, orders=[])
    assert empty.table("dim_dates").count() == 0


# -- repeated rows ----------------------------------------------------------


@pytest.fixture
def fanned(spark):
    """One order with two items, two payments and two reviews."""
    return micro.warehouse(
        spark,
        order_items=micro.rows("order_items", {}, {"order_item_id": "2"}),
        order_payments=micro.rows(
            "order_payments", {}, {"payment_sequential": "2", "payment_type": "voucher"}
        ),
        order_reviews=micro.rows("order_reviews", {}, {"review_id": "r2", "review_score": "2"}),
    )


def test_reviews_repeat_lines(fanned):
    assert one(views.revenue_by_category(fanned))["gmv"] == 400
    assert one(views.revenue_by_category(fanned))["items_sold"] == 4
    exact = one(views.revenue_by_category(fanned, compat=False))
    assert (exact["gmv"], exact["items_sold"], exact["orders"]) == (200, 2, 1)
    assert exact["avg_review_score"] == 3.5
    summary = one(sales.sales_summary(fanned))
    assert (summary["total_gmv"], summary["avg_order_value"]) == (400, 100)
    summary = one(sales.sales_summary(fanned, compat=False))
    assert (summary["total_gmv"], summary["avg_order_value"]) == (200, 200)


def test_payments_are_repeated_by_lines_and_reviews(fanned):
    totals = by(sales.sales_payments(fanned), "payment_type")
    assert (totals["voucher"]["total"], totals["voucher"]["total_value"]) == (4, 400)
    totals = by(sales.sales_payments(fanned, compat=False), "payment_type")
    assert (totals["voucher"]["total"], totals["voucher"]["total_value"]) == (1, 100)
    five = by(sales.sales_payments(fanned, SalesFilter(review_score=5)), "payment_type")
    assert five["voucher"]["total"] == 2


def test_growth_repeats_seller_sales(spark):
    months = ["2018-01-10", "2018-02-10", "2018-03-10"]
    wh = micro.warehouse(
        spark,
        orders=micro.rows(
            "orders",
            *[{"order_id": f"o{i}", "order_purchase_timestamp": f"{m} 00:00:00"} for i, m in enumerate(months)],
        ),
        order_items=micro.rows("order_items", *[{"order_id": f"o{i}"} for i in range(3)]),
        order_reviews=micro.rows("order_reviews", *[{"order_id": f"o{i}", "review_id": f"r{i}"} for i in range(3)]),
    )
    compat, exact = one(features.seller_scores(wh)), one(features.seller_scores(wh, compat=False))
    assert compat["gmv"] == 900 and exact["gmv"] == 300
    assert compat["performance_score"] == exact["performance_score"] == 95.0
    assert compat["revenue_growth_rate"] == 0


# -- scores and segments ----------------------------------------------------


def test_seller_without_deliveries_and_free_first_month(spark):
    wh = micro.warehouse(
        spark,
        orders=micro.rows(
            "orders",
            {"order_id": "o1", "order_status": "canceled"},
            {"order_id": "o2", "order_status": "canceled", "order_purchase_timestamp": "2018-02-10 00:00:00"},
        ),
        order_items=micro.rows(
            "order_items", {"order_id": "o1", "price": "0", "freight_value": "0"}, {"order_id": "o2"}
        ),
        order_reviews=[],
    )
    row = one(features.seller_scores(wh))
    assert row["on_time_delivery_rate"] is None
    assert row["avg_review_score"] == 0 and row["cancellation_rate"] == 1
    assert row["revenue_growth_rate"] == 0
    assert row["performance_score"] == 5.0 and row["risk_tier"] == "high_risk"


def test_tier_boundaries(spark):
    from bazaarlake.functions.bands import recommendation, risk_tier
    from pyspark.sql import functions as F

    scores = spark.createDataFrame([(59.99,), (60.0,), (79.99,), (80.0,)], "score double")
    tiers = [r[0] for r in scores.select(risk_tier(F.col("score"))).collect()]
    assert tiers == ["high_risk", "watchlist", "watchlist", "low_risk"]
    unknown = spark.createDataFrame([("new",)], "tier string").select(recommendation(F.col("tier")))
    assert "healthy" in one(unknown)[0]


def test_segments(spark):
    last = datetime.date(2018, 12, 31)
    people = {
        "recent": [(90, 1)], "needs_1": [(91, 1)], "needs_2": [(365, 1)], "at_risk": [(366, 1)],
        "loyal_2": [(10, 1), (20, 1)],
        "loyal_3": [(10, 166.66), (20, 166.66), (30, 166.67)],
        "champion": [(10, 166.66), (20, 166.67), (30, 166.67)],
    }
    orders_, items, customers = [], [], []
    for person, bought in people.items():
        for n, (age, spend) in enumerate(bought):
            key = f"{person}-{n}"
            day = last - datetime.timedelta(days=age)
            customers.append({"customer_id": key, "customer_unique_id": person})
            orders_.append({"order_id": key, "customer_id": key, "order_purchase_timestamp": f"{day} 12:00:00"})
            items.append({"order_id": key, "price": str(spend), "freight_value": "0"})
    # The latest order was never delivered but still sets the date.
    orders_.append({"order_id": "x", "customer_id": "x", "order_status": "shipped",
                    "order_purchase_timestamp": f"{last} 00:00:00"})
    wh = micro.warehouse(
        spark,
        customers=micro.rows("customers", *customers),
        orders=micro.rows("orders", *orders_),
        order_items=micro.rows("order_items", *items),
    )
    found = by(features.customer_rfm(wh), "customer_unique_id")
    assert {p: r["rfm_segment"] for p, r in found.items()} == {
        "recent": "recent", "needs_1": "needs_attention", "needs_2": "needs_attention",
        "at_risk": "at_risk", "loyal_2": "loyal", "loyal_3": "loyal", "champion": "champions",
    }
    assert found["loyal_3"]["monetary"] == 499.99 and found["recent"]["recency_days"] == 90


def test_cohorts_are_sparse_and_cross_years(spark):
    bought = {"p1": ["2017-12-05", "2018-03-01", "2018-03-02"], "p2": ["2017-12-31"]}
    customers, orders_ = [], []
    for person, days in bought.items():
        for n, day in enumerate(days):
            key = f"{person}-{n}"
            customers.append({"customer_id": key, "customer_unique_id": person})
            orders_.append({"order_id": key, "customer_id": key, "order_purchase_timestamp": f"{day} 00:00:00"})
    wh = micro.warehouse(
        spark, customers=micro.rows("customers", *customers), orders=micro.rows("orders", *orders_)
    )
    assert [tuple(r) for r in features.cohort_retention(wh).collect()] == [
        ("2017-12", 0, 2, 2, 1.0),
        ("2017-12", 3, 1, 2, 0.5),
    ]
    matrix = one(measures.cohort_heatmap(wh))
    assert (matrix["month_0"], matrix["month_1"], matrix["month_3"]) == (1.0, None, 0.5)


def test_lanes(spark):
    wh = micro.warehouse(
        spark,
        customers=micro.rows(
            "customers",
            {"customer_zip_code_prefix": "1"}, {"customer_id": "c2", "customer_zip_code_prefix": "2"},
        ),
        orders=micro.rows(
            "orders",
            {"order_purchase_timestamp": "2018-01-10 00:00:00", "order_delivered_customer_date": "2018-01-14 00:00:00"},
            {"order_id": "o2", "order_delivered_customer_date": ""},
            {"order_id": "o3", "customer_id": "c2"},
        ),
        order_items=micro.rows("order_items", {}, {"order_id": "o2"}, {"order_id": "o3"}),
        sellers=micro.rows("sellers", {"seller_zip_code_prefix": "1"}),
        geolocation=micro.rows("geolocation", {"geolocation_zip_code_prefix": "1"}),
    )
    lanes = by(features.delivery_lanes(wh), "destination_zip")
    # A missing delivery counts as 0 days, unless exact.
    assert (lanes[1]["orders"], lanes[1]["avg_delivery_days"]) == (2, 2.0)
    assert lanes[1]["avg_distance_km"] == 0 and lanes[2]["avg_distance_km"] is None
    exact = by(features.delivery_lanes(wh, compat=False), "destination_zip")
    assert exact[1]["avg_delivery_days"] == 4.0
    estimate = one(orders.delivery_estimate(features.delivery_lanes(wh), "00001", "1"))
    assert estimate["estimated_delivery_days"] == 2 and estimate["historical_orders"] == 2
    assert orders.delivery_estimate(features.delivery_lanes(wh), "9", "9").count() == 0
    assert measures.distance_vs_days(features.delivery_lanes(wh)).count() == 1


# -- filters ----------------------------------------------------------------


def test_fiscal_edges(spark):
    moments = {"o1": "2018-03-31 23:59:59", "o2": "2018-04-01 00:00:00", "o3": "2018-07-01 00:00:00",
               "o4": "2018-12-31 00:00:00"}
    wh = micro.warehouse(
        spark,
        orders=micro.rows("orders", *[{"order_id": k, "order_purchase_timestamp": t} for k, t in moments.items()]),
        order_items=micro.rows("order_items", *[{"order_id": k} for k in moments]),
        order_reviews=[],
    )

    def months(**given):
        return [r["month"] for r in sales.sales_trend(wh, SalesFilter(**given)).collect()]

    assert months(financial_year="2017-2018") == ["2018-03"]
    assert months(financial_year="2018-2019") == ["2018-04", "2018-07", "2018-12"]
    assert len(months(financial_year="soon")) == 4 and len(months(financial_year="")) == 4
    assert [months(quarter=q) for q in (1, 2, 3, 4)] == [["2018-04"], ["2018-07"], ["2018-12"], ["2018-03"]]
    assert months(month=7) == ["2018-07"] and months(quarter=0, month=0) == months()
    with pytest.raises(ValueError):
        SalesFilter(quarter=5)
    years = [r[0] for r in options.financial_years(wh).collect()]
    assert years == ["All Years", "2018-2019"]


def test_argument_bounds(spark):
    wh = micro.warehouse(spark)
    for call in (
        lambda: orders.orders_recent(wh, 101),
        lambda: orders.repeat_orders_by_city(wh, limit=501),
        lambda: orders.repeat_orders_by_city(wh, min_repeat_orders=1),
        lambda: sales.sales_map(wh, limit=0),
        lambda: sales.sales_categories(wh, limit=21),
        lambda: sales.sales_seller_leaderboard(wh, limit=101),
        lambda: sellers.seller_score_leaderboard(features.seller_scores(wh), limit=5001),
        lambda: sellers.seller_score_leaderboard(features.seller_scores(wh), sort="middling"),
    ):
        with pytest.raises(ValueError):
            call()


def test_filters_without_matches(spark):
    wh = micro.warehouse(spark)
    nothing = SalesFilter(customer_city="nowhere")
    summary = one(sales.sales_summary(wh, nothing))
    assert tuple(summary) == (0.0, 0, 0, 0, 0.0, 0.0, 0.0)
    assert sales.sales_map(wh, nothing).count() == 0
    assert sales.insight_best_category(wh, nothing).count() == 0
    assert one(sales.sales_summary(wh, SalesFilter(payment_type="boleto")))["total_gmv"] == 0
    assert one(sales.sales_summary(wh, SalesFilter(review_score=5)))["total_gmv"] == 100


# -- orphans ----------------------------------------------------------------


def test_orphans_stay_in_left_joins(spark):
    wh = micro.warehouse(
        spark,
        order_items=micro.rows(
            "order_items", {}, {"order_id": "lost"}, {"product_id": "gone", "order_item_id": "2"},
            {"seller_id": "nobody", "order_item_id": "3"},
        ),
        orders=micro.rows("orders", {}, {"order_id": "o9", "customer_id": "stranger"}),
        order_payments=micro.rows("order_payments", {}, {"order_id": "lost", "payment_type": "boleto"}),
        order_reviews=micro.rows("order_reviews", {}, {"order_id": "lost", "review_score": "1"},
                                 {"order_id": "lost", "review_id": "r3", "review_score": "1"}),
    )
    trend = by(sales.sales_trend(wh), "month")
    # The review of a lost order still repeats its line.
    assert trend[None]["gmv"] == 200 and trend["2018-01"]["gmv"] == 300
    # Here reviews hang on the order, and a lost order has none.
    board = by(sales.sales_seller_leaderboard(wh), "seller_id")
    assert set(board) == {"s1"} and board["s1"]["total_gmv"] == 300
    assert board["s1"]["avg_review_score"] == 5
    payments = by(sales.sales_payments(wh), "payment_type")
    assert payments["boleto"]["total"] == 1 and payments["credit_card"]["total"] == 3
    checks = by(quality.report(wh), "check")
    assert checks["order_items_have_orders"]["value"] == 1
    assert checks["orders_have_customers"]["value"] == 1
    assert checks["orders_have_customers"]["status"] == "FAIL"
    links = by(quality.relationships(wh), "relationship")
    assert links["items_to_sellers"]["orphans"] == 1
    with pytest.raises(quality.QualityError):
        quality.enforce(quality.report(wh))


def test_quality_failures_are_all_reported(spark):
    wh = micro.warehouse(
        spark,
        orders=micro.rows("orders", {}, {}, {"order_id": None}),
        order_payments=micro.rows("order_payments", {"payment_value": "-0.01"}),
    )
    checks = by(quality.report(wh), "check")
    assert checks["orders_have_unique_ids"]["value"] == 2
    assert checks["payments_are_non_negative"]["value"] == 1
    assert checks["customers_have_unique_ids"]["status"] == "PASS"
    nulls = {(r["table"], r["column"]): r["nulls"] for r in quality.not_null(wh).collect()}
    assert nulls["stg_orders", "order_id"] == 1
    duplicates = by(quality.unique(wh), "table")
    assert duplicates["stg_orders"]["duplicates"] == 1


def test_unknown_category_is_two_rows_unless_exact(spark):
    wh = micro.warehouse(
        spark,
        products=micro.rows("products", {"product_category_name": "unknown"}),
        order_items=micro.rows("order_items", {}, {"order_item_id": "2", "product_id": "gone"}),
    )
    assert [r["category"] for r in sales.sales_categories(wh).collect()] == ["unknown", "unknown"]
    assert one(sales.sales_categories(wh, compat=False))["gmv"] == 200
    assert one(views.revenue_by_category(wh))["orders"] == 1


def test_repeat_orders(spark):
    keys = ["o1", "o2", "o3"]
    wh = micro.warehouse(
        spark,
        customers=micro.rows("customers", *[{"customer_id": k} for k in keys]),
        orders=micro.rows("orders", *[{"order_id": k, "customer_id": k} for k in keys]),
        order_items=micro.rows("order_items", *[{"order_id": k} for k in keys], {"order_item_id": "2"}),
    )
    row = one(orders.repeat_orders_by_city(wh, city="CAMPINAS"))
    assert (row["repeat_customers"], row["repeat_orders"], row["gmv"]) == (1, 3, 400)
    assert row["avg_repeat_orders_per_customer"] == 3
    assert orders.repeat_orders_by_city(wh, min_repeat_orders=4).count() == 0
    assert orders.repeat_orders_by_city(wh, city="santos").count() == 0


def test_growth_skips_a_missing_month(spark):
    months = ["2018-01", "2018-02", "2018-04"]
    wh = micro.warehouse(
        spark,
        orders=micro.rows("orders", *[
            {"order_id": m, "order_purchase_timestamp": f"{m}-01 00:00:00"} for m in months]),
        order_items=micro.rows("order_items", *[
            {"order_id": m, "price": str(50 * (n + 1)), "freight_value": "0"} for n, m in enumerate(months)]),
    )
    growth = by(measures.monthly_gmv_growth(wh), "month")
    assert growth["2018-01"]["growth_pct"] is None
    assert growth["2018-02"]["growth_pct"] == 100
    assert growth["2018-04"]["prior_month_gmv"] is None


def test_display_bands(spark):
    wh = micro.warehouse(spark)
    assert one(display.kpi_bands(wh))["review_band"] == "Excellent"
    bubble = one(display.map_layer(wh))
    assert bubble["bubble_radius"] == pytest.approx(3 * (100 / 500) ** 0.5, abs=1e-6)
    assert (bubble["latitude"], bubble["review_color"]) == (-23.5, "#16A34A")
    assert one(display.seller_bands(wh))["late_color"] == "#16A34A"


def test_rank_matches_the_leaderboard(spark):
    scores = spark.createDataFrame(
        [(f"s{i}", "x", "Y", 5, 1.0, 1.0, 1.0, 0.0, 0.0, score, "low_risk")
         for i, score in enumerate([70.0, 90.0, 90.0, 80.0])],
        "seller_id string, seller_city string, seller_state string, orders bigint, gmv double,"
        "on_time_delivery_rate double, avg_review_score double, cancellation_rate double,"
        "revenue_growth_rate double, performance_score double, risk_tier string",
    )
    board = sellers.seller_score_leaderboard(scores, limit=3).collect()
    assert [(r["seller_id"], r["rank"]) for r in board] == [("s1", 1), ("s2", 2), ("s3", 3)]
    assert board[0]["total_matching_sellers"] == 4 and board[0]["count_returned"] == 3
    for seller, rank in {"s0": 4, "s1": 1, "s2": 2, "s3": 3}.items():
        assert one(sellers.seller_detail(scores, seller))["rank"] == rank
    assert sellers.seller_detail(scores, "s9").count() == 0
    worst = sellers.seller_score_leaderboard(scores, sort="worst", limit=1)
    assert one(worst)["seller_id"] == "s0"
    text = scores.selectExpr("* EXCEPT (gmv, orders)", "'' AS gmv", "'5' AS orders")
    assert one(sellers.seller_score_lookup(text, "s1"))["gmv"] == 0


def test_lines_without_a_price_are_left_out_of_the_mean(spark):
    wh = micro.warehouse(
        spark, order_items=micro.rows("order_items", {"price": "100.00", "freight_value": "0"}, {"order_item_id": "2", "price": ""})
    )
    assert sales.sales_summary(wh).first()["avg_order_value"] == 100.0


def test_unknown_buyers_are_one_person(spark):
    wh = micro.warehouse(
        spark,
        orders=micro.rows("orders", {}, {"order_id": "o2", "customer_id": "nobody"}),
        order_items=micro.rows("order_items", {}, {"order_id": "o2"}),
    )
    assert {r["customer_unique_id"] for r in features.customer_rfm(wh).collect()} >= {None}
    assert features.cohort_retention(wh).first()["cohort_size"] == 2


def test_totals_beyond_a_machine_word(spark):
    cents = spark.range(40).select(F.lit(9 * 10**17).alias("c"), (F.lit(-7) - F.col("id")).alias("d"))
    row = cents.agg(numeric.exact_sum(F.col("c")).cast("string").alias("c"), numeric.exact_sum(F.col("d")).alias("d")).first()
    assert row["c"] == str(40 * 9 * 10**17) and row["d"] == -sum(range(7, 47))
