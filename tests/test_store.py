"""Files, storage, build, refresh and streaming ingest."""

import json
import os
import re

import pytest

import micro
from bazaarlake.plans import audit, build, features, measures, quality, sales, sellers, views
from bazaarlake.plans.warehouse import Warehouse
from bazaarlake.sources import files, records
from bazaarlake.sources.schemas import COLUMNS
from bazaarlake.sources.storage import TableStore
from bazaarlake.streaming import ingest


@pytest.fixture
def store(spark, tmp_path):
    micro.write_csvs(f"{tmp_path}/in")
    return build.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", export_to=f"{tmp_path}/reports")


@pytest.fixture(scope="module")
def shared(spark, tmp_path_factory):
    """A store that tests only read, or whose refused batches leave as it is."""
    folder = str(tmp_path_factory.mktemp("shared"))
    micro.write_csvs(f"{folder}/in")
    return build.run(spark, f"{folder}/in", f"{folder}/out")


def test_csv_scan_is_lenient(spark, tmp_path):
    path = f"{tmp_path}/order_reviews.csv"
    with open(path, "w", encoding="utf-8") as handle:
        handle.write("﻿" + ",".join(COLUMNS["order_reviews"]) + "\n")
        handle.write('r1,o1,5,"a ""quoted"" title","two\nlines",,\n')
        handle.write("r2,o1\n")
        handle.write("r3,o1,4,t,m,2018-01-01,2018-01-02,surplus\n")
    found = {r["review_id"]: r for r in files.scan_csv(spark, path, "order_reviews").collect()}
    assert found["r1"]["review_comment_message"] == "two\nlines"
    assert found["r1"]["review_comment_title"] == 'a "quoted" title'
    assert found["r1"]["review_creation_date"] is None
    assert found["r2"]["review_score"] is None
    assert found["r3"]["review_answer_timestamp"] == "2018-01-02"


def test_missing_file_is_named_before_any_write(spark, tmp_path):
    micro.write_csvs(f"{tmp_path}/in")
    os.remove(f"{tmp_path}/in/sellers.csv")
    with pytest.raises(FileNotFoundError, match="sellers.csv"):
        build.run(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert not os.path.exists(f"{tmp_path}/out")


def test_run_without_confirmation_writes_nothing(spark, tmp_path):
    micro.write_csvs(f"{tmp_path}/in")
    assert build.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", confirm=False) is None
    assert not os.path.exists(f"{tmp_path}/out")


def test_stored_warehouse_answers_like_the_computed_one(spark, tmp_path, store):
    stored, computed = build.open_warehouse(store), micro.warehouse(spark)
    for query in (sales.sales_summary, sales.sales_map, sales.sales_payments, views.delivery_sla_by_state):
        assert query(stored).collect() == query(computed).collect()
    plan = sales.filtered_lines(
        stored, sales.SalesFilter(financial_year="2017-2018")
    )._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(purchase_month" in plan
    assert os.path.exists(f"{tmp_path}/reports/seller_scores")


def _plan(df):
    """The plan as it is made before it runs, each operator with its details."""
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.mark.parametrize(
    "query",
    [sales.sales_summary, sales.sales_map, views.revenue_by_category, views.seller_performance_base, features.seller_scores],
)
def test_lines_in_buckets_are_not_moved(spark, shared, query):
    plan = _plan(query(build.open_warehouse(shared)))
    assert "hashpartitioning(order_id" not in plan
    # Each table is read once, bucket by bucket.
    assert plan.count("Bucketed: true") == 2


def test_reviews_and_payments_meet_in_buckets(spark, shared):
    wh = build.open_warehouse(shared)
    plan = _plan(sales.sales_trend(wh, sales.SalesFilter(payment_type="credit_card", review_score=5)))
    assert "hashpartitioning(order_id" not in plan and plan.count("Bucketed: true") == 3


def test_a_hot_order_is_stored_without_buckets(spark, tmp_path):
    store = TableStore(spark, f"{tmp_path}/hot")
    items = micro.rows("order_items", *[{"order_id": "o1", "order_item_id": str(i)} for i in range(60)])
    data = micro.raw(spark, order_items=items)
    build.publish(store, data)
    buckets = {n: t.buckets for n, t in store.tables().items() if n in build.BUCKETED}
    assert buckets["order_lines"] is None
    computed = sales.sales_summary(Warehouse(raw=data)).collect()
    assert sales.sales_summary(build.open_warehouse(store)).collect() == computed


def test_buckets_keep_their_number(spark, store):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        build.refresh(store, ["order_reviews"], whole=True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    numbers = {t.buckets.number for t in store.tables().values() if t.buckets}
    assert len(numbers) == 1


def test_append_previews_then_stores_once(spark, store):
    row = spark.createDataFrame(
        micro.rows("sellers", {"seller_id": "s2"}), COLUMNS["sellers"]
    )
    before = store.raw("sellers").count()
    assert build.append(store, "sellers", row).count() == 1
    assert store.raw("sellers").count() == before
    for _ in range(2):
        build.append(store, "sellers", row, confirm=True, delivery="d1")
    assert store.raw("sellers").count() == before + 1
    first_load_only = store.raw("sellers", before_batch=1)
    assert first_load_only.count() == before
    build.refresh(store, ["sellers"])
    assert store.version() == 1
    assert store.read("dim_sellers").count() == 2
    # Tables that do not depend on sellers keep their folder.
    assert store.tables(0)["stg_orders"] == store.tables(1)["stg_orders"]
    assert store.tables(0)["dim_sellers"] != store.tables(1)["dim_sellers"]


def test_records_are_validated(spark):
    row = spark.createDataFrame([("a", "b")], "seller_id string, colour string")
    with pytest.raises(ValueError, match="missing columns: seller_zip_code_prefix"):
        records.validate("sellers", row)
    full = spark.createDataFrame(micro.rows("sellers", {}), COLUMNS["sellers"])
    with pytest.raises(ValueError, match="unknown columns: extra"):
        records.validate("sellers", full.selectExpr("*", "1 AS extra"))
    with pytest.raises(ValueError, match="unknown dataset"):
        records.validate("buyers", full)


def test_catalog_and_sample(spark):
    catalog = records.dataset_catalog(spark, "/data")
    assert catalog.count() == sum(len(c) for c in COLUMNS.values())
    data = micro.raw(spark, sellers=micro.rows("sellers", *[{"seller_id": f"s{i}"} for i in range(9)]))
    sample = records.dataset_sample(data, "sellers", 3).collect()
    assert [r["seller_id"] for r in sample] == ["s0", "s1", "s2"]
    with pytest.raises(ValueError):
        records.dataset_sample(data, "sellers", 51)


def test_failed_check_keeps_the_old_version(spark, store):
    bad = spark.createDataFrame(
        micro.rows("order_payments", {"payment_value": "-1"}), COLUMNS["order_payments"]
    )
    # As if it had come in unaudited.
    store.write_raw("order_payments", bad, store.batch_of("past the audit"))
    with pytest.raises(quality.QualityError, match="payments_are_non_negative"):
        build.refresh(store, ["order_payments"])
    assert store.version() == 0
    # Set aside, the batch no longer stands in the way of good ones.
    store.set_aside(1, "negative payment")
    good = spark.createDataFrame(micro.rows("sellers", {"seller_id": "s2"}), COLUMNS["sellers"])
    build.append(store, "sellers", good, confirm=True)
    build.refresh(store, ["order_payments", "sellers"])
    assert store.version() == 1 and store.read("dim_sellers").count() == 2
    assert spark.read.parquet(f"{store.root}/set_aside/batch=1/order_payments").count() == 1


@pytest.mark.parametrize(
    "dataset, changes, reasons",
    [
        ("order_payments", [{"payment_value": "-1"}, {}], ["negative payment"]),
        ("customers", [{"customer_id": "c1"}, {"customer_id": "c9"}], ["repeated customer_id"]),
        ("customers", [{"customer_id": ""}, {"customer_id": "c9"}, {"customer_id": "c9"}], ["no customer_id", "repeated customer_id"]),
        ("orders", [{"order_id": "o9", "customer_id": "nobody"}, {"order_id": "o1"}], ["repeated order_id", "unknown customer_id"]),
        ("order_items", [{"order_id": "nothing"}, {"order_id": ""}, {}], ["no order_id", "unknown order_id"]),
    ],
)
def test_bad_append_changes_nothing(spark, shared, dataset, changes, reasons):
    rows = spark.createDataFrame(micro.rows(dataset, *changes), COLUMNS[dataset])
    before = shared.raw(dataset).count()
    with pytest.raises(audit.RefusedBatch) as refused:
        build.append(shared, dataset, rows, confirm=True, delivery="d")
    assert refused.value.failures == reasons
    assert sorted({r["reason"] for r in refused.value.rows.collect()}) == reasons
    assert shared.raw(dataset).count() == before and shared.version() == 0


def test_after_a_refusal_the_mended_batch_comes_in(spark, store):
    def orders(*changes):
        return spark.createDataFrame(micro.rows("orders", *changes), COLUMNS["orders"])

    with pytest.raises(audit.RefusedBatch):
        build.append(store, "orders", orders({"order_id": "o2"}, {"order_id": "o2"}), confirm=True, delivery="d")
    for _ in range(2):  # handed in again, a batch does not repeat its own keys
        build.append(store, "orders", orders({"order_id": "o2"}, {"order_id": "o3"}), confirm=True, delivery="d")
    build.refresh(store, ["orders"])
    assert store.version() == 1 and store.read("order_heads").count() == 3
    with pytest.raises(audit.RefusedBatch):
        build.append(store, "orders", orders({"order_id": "o3"}), confirm=True)


def test_only_touched_buckets_of_the_key_index_are_read(spark, store):
    rows = micro.rows("customers", *[{"customer_id": f"k{i}"} for i in range(300)])
    store.write_raw("customers", spark.createDataFrame(rows, COLUMNS["customers"]), 1)
    asked = spark.createDataFrame([("k7",), ("unheard",), ("c1",), (None,)], "key string")
    known = store.known_keys("customers", asked, 5)
    assert sorted(r["key"] for r in known.collect()) == ["c1", "k7"]
    assert [r["key"] for r in store.known_keys("customers", asked, 1).collect()] == ["c1"]
    # Three buckets at most of some 180.
    pruned = re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN \(([\d,]+)\)", _plan(known))
    assert pruned and len(pruned[1].split(",")) <= 3 and "raw/customers" not in _plan(known)
    store.set_aside(1, "test")
    assert [r["key"] for r in store.known_keys("customers", asked, 5).collect()] == ["c1"]


def test_stream_goes_on_after_a_bad_batch(spark, tmp_path, store):
    drop, checkpoint = f"{tmp_path}/drop", f"{tmp_path}/checkpoint"
    _drop(drop, "a.json", _record("order_items", order_id="nobody's"), _record("order_payments", payment_value="-2"))
    ingest.start(store, drop, checkpoint).awaitTermination(300)
    assert store.version() == 0
    assert [r["reason"] for r in spark.read.json(f"{store.root}/rejected").collect()] == ["negative payment"]
    assert spark.read.parquet(f"{store.root}/set_aside/batch=1/order_items").count() == 1
    _drop(drop, "b.json", _record("sellers", seller_id="s2"))
    ingest.start(store, drop, checkpoint).awaitTermination(300)
    assert store.version() == 1


def test_stored_reports_and_skew_are_read(spark, store):
    wh = build.open_warehouse(store)
    assert "order_id" in wh.skew.measured
    report = wh.report("seller_scores", None)
    plan = sellers.seller_detail(report, "s1")._jdf.queryExecution().optimizedPlan().toString()
    assert "order_lines" not in plan and "stg_order_items" not in plan


def test_momentum_reads_two_months(spark, store):
    plan = measures.city_momentum(build.open_warehouse(store))._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan


def _drop(folder, name, *lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.{name}", "w", encoding="utf-8") as handle:
        handle.writelines(line + "\n" for line in lines)
    os.rename(f"{folder}/.{name}", f"{folder}/{name}")


def _record(dataset, **changes):
    row = micro.rows(dataset, changes)[0]
    return json.dumps({"dataset": dataset, "data": dict(zip(COLUMNS[dataset], row))})


def test_streaming_equals_batch(spark, tmp_path, store):
    drop, checkpoint = f"{tmp_path}/drop", f"{tmp_path}/checkpoint"
    _drop(
        drop, "a.json",
        _record("customers", customer_id="c2", customer_unique_id="p2"),
        _record("orders", order_id="o2", customer_id="c2"),
        _record("order_items", order_id="o2", price="40.00"),
        json.dumps({"dataset": "buyers", "data": {}}),
        json.dumps({"dataset": "sellers", "data": {"seller_id": "s9"}}),
        json.dumps({"dataset": "category_translation", "data": {
            "product_category_name": "a", "product_category_name_english": "b", "extra": "c"}}),
        "not json",
    )
    reports = build.LiveReports(store)
    assert reports.get("customer_rfm").count() == 1
    ingest.start(store, drop, checkpoint, on_refresh=reports.reload).awaitTermination(300)
    assert reports.get("customer_rfm").count() == 2

    reasons = {r["reason"] for r in spark.read.json(f"{store.root}/rejected").collect()}
    assert reasons == {
        "unknown dataset: buyers",
        "missing columns: seller_zip_code_prefix, seller_city, seller_state",
        "unknown columns: extra",
        "unreadable record",
    }
    batch = micro.warehouse(
        spark,
        customers=micro.rows("customers", {}, {"customer_id": "c2", "customer_unique_id": "p2"}),
        orders=micro.rows("orders", {}, {"order_id": "o2", "customer_id": "c2"}),
        order_items=micro.rows("order_items", {}, {"order_id": "o2", "price": "40.00"}),
    )
    expected = sales.sales_summary(batch).collect()
    assert sales.sales_summary(build.open_warehouse(store)).collect() == expected
    assert store.version() == 1

    # The same stream again: nothing new. A second file: a new version.
    ingest.start(store, drop, checkpoint).awaitTermination(300)
    assert store.version() == 1
    _drop(drop, "b.json", _record("sellers", seller_id="s2"))
    ingest.start(store, drop, checkpoint).awaitTermination(300)
    assert store.version() == 2
    assert store.read("dim_sellers").count() == 2


def test_replayed_batch_changes_nothing(spark, tmp_path, store):
    records_in = spark.createDataFrame(
        [("sellers", dict(zip(COLUMNS["sellers"], micro.rows("sellers", {"seller_id": "s2"})[0])), None)],
        ingest.RECORD,
    )
    for _ in range(2):
        batch = store.batch_of("stream q 0")
        assert ingest.store_batch(store, records_in, batch) == ["sellers"]
        build.refresh(store, ["sellers"])
    assert store.read("dim_sellers").count() == 2


def test_stream_into_an_empty_store(spark, tmp_path):
    store = TableStore(spark, f"{tmp_path}/out")
    _drop(f"{tmp_path}/drop", "a.json", _record("sellers"))
    ingest.start(store, f"{tmp_path}/drop", f"{tmp_path}/checkpoint").awaitTermination(300)
    wh = build.open_warehouse(store)
    assert store.read("dim_sellers").count() == 1
    assert store.read("seller_scores").count() == 0
    assert tuple(sales.sales_summary(wh).first()) == (0.0, 0, 0, 0, 0.0, 0.0, 0.0)
