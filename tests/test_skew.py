"""Uneven keys: found, salted, and without influence on any figure."""

import importlib

import pytest
from pyspark.sql import functions as F

import compare
import micro
from bazaarlake.operators.skew import ROW, HotKeys, SkewProfile, measure, scan_order, skew_join
from bazaarlake.plans import features, measures, sales, views
from bazaarlake.plans.warehouse import Warehouse

FOLDER = "/root/testdata/sf0.001"
entry = importlib.import_module("__spark_entry__")

# Every kind of join key salted, some of them absent from the data.
FORCED = SkewProfile(
    {
        "order_id": HotKeys({"7": 5, "12": 2, "29": 3, "none": 4}),
        "product_id": HotKeys({"1": 3, "50": 2, "61": 2, None: 3}),
        "seller_id": HotKeys({"1": 4, "2": 2, "3": 4}),
        "customer_id": HotKeys({"c7": 3, "c12": 2, None: 3}),
        "customer_zip_code_prefix": HotKeys({1001: 2, 1002: 2}),
        "seller_zip_code_prefix": HotKeys({5001: 2}),
        "product_category_name": HotKeys({"small": 3, None: 3}),
    }
)


def test_hot_keys_are_found(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "big").otherwise(F.col("id").cast("string")).alias("a"),
        F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.col("id")).alias("b"),
        F.col("id").alias("c"),
    )
    profile = measure(rows, ["a", "b", "c"])
    # 16 half tasks of 187 rows: a third of the rows fills six of them, half of the rows eight.
    assert profile["a"].salts == {"big": 6}
    assert profile["b"].salts == {None: 8}
    assert not profile["c"] and not profile["unmeasured"]
    assert SkewProfile.from_json(profile.to_json()) == profile


def test_hot_keys_for_any_number_of_tasks(spark):
    rows = spark.range(4_000_000).select(
        F.when(F.col("id") % 10 == 0, "big").otherwise(F.col("id").cast("string")).alias("k")
    )
    salts = measure(rows, ["k"], tasks=1_000_000)["k"].salts
    # A half task has two rows: keys that occur once are none.
    assert salts == {"big": 200_000}
    assert measure(rows, ["k"], tasks=1_000)["k"].salts == {"big": 200}
    assert not measure(rows, ["k"], tasks=2)["k"]
    assert not measure(rows.limit(0), ["k"])["k"]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_is_the_join(spark, how):
    left = spark.range(60).select(
        F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"),
        (F.col("id") % 2).alias("v"),
    )
    right = spark.createDataFrame([("big", 1), ("big", 2), ("4", 3), ("zz", 4), (None, 5)], "k string, w int")
    hot = HotKeys({"big": 7, "zz": 2, None: 5})
    expected = compare.spark_rows(left.join(right, "k", how))
    assert compare.spark_rows(skew_join(left, right, "k", hot, how)) == expected
    numbered = left.withColumn(ROW, scan_order())
    assert compare.spark_rows(skew_join(numbered, right, "k", hot, how).drop(ROW)) == expected


def test_exact_copies_of_a_row_are_spread(spark):
    copies = spark.range(400).select(F.lit("big").alias("k"), scan_order().alias(ROW))
    right = spark.createDataFrame([("big", 1)], "k string, w int")
    hot = HotKeys({"big": 8})
    joined = skew_join(copies, right, "k", hot)
    assert joined.count() == 400
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


@pytest.mark.parametrize(
    "name",
    [
        "fct_orders",
        "fct_order_items",
        "dim_customers",
        "dim_sellers",
        "dim_products",
        "revenue_by_category",
        "delivery_sla_by_state",
        "seller_scores",
        "customer_rfm",
        "cohort_retention",
        "delivery_lanes",
        "repeat_orders_by_city",
        "sales_summary",
        "sales_map",
        "sales_map_exact",
        "sales_seller_leaderboard",
        "sales_payments",
        "filter_everything",
        "ingest_impact",
        "dq_report",
    ],
)
def test_salting_changes_no_figure(spark, name):
    plain = entry.warehouse(spark, FOLDER)
    salted = Warehouse(raw=plain.raw, skew=FORCED)
    job = entry.jobs()[name]
    assert compare.spark_rows(job(salted)) == compare.spark_rows(job(plain))


def test_one_order_with_many_lines_and_reviews(spark):
    """The row-by-row join would be 300 x 200 rows for this order."""
    items = [{"order_item_id": str(i)} for i in range(300)]
    reviews = [{"review_id": f"r{i}", "review_score": str(1 + i % 5)} for i in range(200)]
    wh = micro.warehouse(
        spark,
        order_items=micro.rows("order_items", *items),
        order_reviews=micro.rows("order_reviews", *reviews),
        order_payments=micro.rows("order_payments", {}, {"payment_sequential": "2"}),
    )
    row = views.revenue_by_category(wh).first()
    assert (row["items_sold"], row["gmv"], row["orders"]) == (60_000, 6_000_000, 1)
    assert row["avg_review_score"] == 3
    payment = sales.sales_payments(wh).first()
    assert (payment["total"], payment["total_value"]) == (120_000, 12_000_000)


# -- properties -------------------------------------------------------------


@pytest.fixture(scope="module")
def wh(spark):
    return entry.warehouse(spark, "/root/testdata/sf0.01")


def test_exact_sales_all_add_up(wh):
    total = measures.measures(wh).first()["total_gmv"]

    def gmv(df, column="gmv"):
        return df.agg(F.sum(column)).first()[0]

    parts = [
        gmv(views.revenue_by_category(wh, compat=False)),
        gmv(views.seller_performance_base(wh, compat=False)),
        gmv(sales.sales_map(wh, limit=500, compat=False)),
        gmv(sales.sales_categories(wh, limit=20, compat=False)),
        gmv(sales.sales_trend(wh, compat=False)),
        gmv(measures.gmv_by_city(wh)),
    ]
    assert parts == pytest.approx([total] * len(parts))


def test_compat_seller_sales_are_exact_times_months(wh):
    months = wh.lines().groupBy("seller_id").agg(F.count_distinct("purchase_month").alias("months"))
    compat = features.seller_scores(wh).select("seller_id", F.col("gmv").alias("c"), F.col("performance_score").alias("cs"))
    exact = features.seller_scores(wh, compat=False).select("seller_id", "gmv", "performance_score")
    off = compat.join(exact, "seller_id").join(months, "seller_id").filter(
        (F.abs(F.col("c") - F.col("gmv") * F.col("months")) > 0.01)
        | (F.abs(F.col("cs") - F.col("performance_score")) > 0.01)
        | ~F.col("cs").between(0, 100)
    )
    assert off.count() == 0


def test_everyone_is_in_one_segment_and_in_month_zero(wh):
    rfm = features.customer_rfm(wh)
    assert rfm.count() == rfm.select("customer_unique_id").distinct().count()
    start = features.cohort_retention(wh).filter("month_number = 0")
    assert start.filter("retention_rate <> 1 OR customers <> cohort_size").count() == 0
