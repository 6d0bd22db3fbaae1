"""Stream records that come before their parents, repeat keys or meet faults of others."""

import pytest
from pyspark.errors import StreamingQueryException

import micro
from bazaarlake.plans import build
from bazaarlake.sources.schemas import COLUMNS
from bazaarlake.streaming import ingest
from test_store import _drop, _record, store  # noqa: F401


def _stream(store, tmp_path):
    ingest.start(store, f"{tmp_path}/drop", f"{tmp_path}/checkpoint").awaitTermination(300)


def test_orphans_wait_and_the_others_come_in(spark, tmp_path, store):  # noqa: F811
    drop = f"{tmp_path}/drop"
    _drop(
        drop, "a.json",
        _record("order_items", order_id="o2"),
        _record("order_items", order_id=""),
        _record("orders", order_id="o1"),
        _record("customers", customer_id="c1"),
        _record("sellers", seller_id="s2"),
        _record("orders", order_id="o3", customer_id="c9"),
    )
    _stream(store, tmp_path)
    assert store.version() == 1 and store.read("dim_sellers").count() == 2
    assert store.raw("order_items").count() == store.raw("orders").count() == 1
    reasons = sorted(r["reason"] for r in spark.read.json(f"{store.root}/rejected").collect())
    assert reasons == ["no order_id", "repeated customer_id", "repeated order_id"]
    assert spark.read.parquet(f"{store.root}/set_aside/batch=1/order_items").count() == 1

    _drop(drop, "b.json", *[_record("orders", order_id="o2")] * 2, _record("order_items", order_id="o3"))
    _stream(store, tmp_path)
    assert store.version() == 2
    assert sorted(r["order_id"] for r in store.raw("order_items").collect()) == ["o1", "o2"]

    _drop(drop, "c.json", _record("customers", customer_id="c9"))
    _stream(store, tmp_path)
    assert sorted(r["order_id"] for r in store.raw("order_items").collect()) == ["o1", "o2", "o3"]
    assert sorted(r["order_id"] for r in store.read("stg_orders").collect()) == ["o1", "o2", "o3"]
    # Nothing waits any more.
    assert all(rows.isEmpty() for rows in store.waiting(99, list(ingest.PARENTS)).values())


def test_faults_of_others_take_no_batch_out(spark, tmp_path, store):  # noqa: F811
    bad = spark.createDataFrame(micro.rows("order_payments", {"payment_value": "-1"}), COLUMNS["order_payments"])
    store.write_raw("order_payments", bad, store.batch_of("past the audit"))
    _drop(f"{tmp_path}/drop", "a.json", _record("order_payments", payment_value="7"))
    with pytest.raises(StreamingQueryException, match="payments_are_non_negative"):
        _stream(store, tmp_path)
    assert store.version() == 0
    store.set_aside(1, "negative payment")
    _stream(store, tmp_path)
    assert store.version() == 1
    assert "7" in {r["payment_value"] for r in store.raw("order_payments").collect()}
