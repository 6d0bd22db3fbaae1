"""Refreshes that add rows and write some months again, against whole builds."""

import random

import pytest

import micro
from bazaarlake.plans import build, increment, sales, views
from bazaarlake.plans.quality import QualityError
from bazaarlake.sources.schemas import COLUMNS
from bazaarlake.sources.storage import TableStore


@pytest.fixture
def store(spark, tmp_path):
    micro.write_csvs(f"{tmp_path}/in")
    return build.run(spark, f"{tmp_path}/in", f"{tmp_path}/out")


def write(store, dataset, batch, *changes):
    rows = micro.rows(dataset, *changes)
    store.write_raw(dataset, store.spark.createDataFrame(rows, COLUMNS[dataset]), batch)


def bag(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def assert_like_a_whole_build(spark, store, folder):
    other = TableStore(spark, folder)
    build.publish(other, store.all_raw())
    ours, whole = store.tables(), other.tables()
    assert ours.keys() == whole.keys()
    for name in [*build.TABLES, *build.REPORTS]:
        assert store.open(ours[name]).dtypes == other.open(whole[name]).dtypes, name
        assert bag(store.open(ours[name])) == bag(other.open(whole[name])), name
    mine, theirs = build.open_warehouse(store), build.open_warehouse(other)
    for query in (sales.sales_summary, sales.sales_map, sales.sales_trend, views.revenue_by_category):
        assert bag(query(mine)) == bag(query(theirs))


def order(n, month, customer="c1", **changes):
    return {"order_id": f"o{n}", "customer_id": customer, "order_purchase_timestamp": f"{month}-07 09:00:00", **changes}


def test_a_record_of_one_month_leaves_the_others(spark, tmp_path, store):
    write(store, "orders", 1, order(2, "2018-02"), order(3, "2018-03"))
    write(store, "order_items", 1, {"order_id": "o2"}, {"order_id": "o3"}, {"order_id": "o3", "order_item_id": "2"})
    build.refresh(store, ["orders", "order_items"])
    write(store, "order_items", 2, {"order_id": "o3", "order_item_id": "3", "price": "7.00"})
    write(store, "order_payments", 2, {"order_id": "o3", "payment_value": "7.00"})
    before = store.tables()
    build.refresh(store, ["order_items", "order_payments"])
    after = store.tables()
    lines = after["order_lines"].folders
    assert {m for m, folder in lines.items() if folder.endswith("/v2")} == {"purchase_month=2018-03"}
    assert {m: f for m, f in lines.items() if "2018-03" not in m} == {
        m: f for m, f in before["order_lines"].folders.items() if "2018-03" not in m
    }
    # Orders are not touched by items; items are added in a folder of their own.
    assert after["order_heads"] == before["order_heads"]
    assert after["stg_order_items"].folders[:-1] == before["stg_order_items"].folders
    assert spark.read.parquet(after["stg_order_items"].folders[-1]).count() == 1
    assert_like_a_whole_build(spark, store, f"{tmp_path}/whole")
    # The version before still reads what it read.
    assert store.read("order_lines", 1).count() == 4 and store.read("order_lines", 2).count() == 5


def test_months_from_several_folders_keep_their_buckets(spark, store):
    write(store, "orders", 1, order(2, "2018-02"))
    write(store, "order_items", 1, {"order_id": "o2"})
    write(store, "order_reviews", 1, {"review_id": "r2", "order_id": "o2"})
    build.refresh(store, ["orders", "order_items", "order_reviews"])
    wh = build.open_warehouse(store)
    query = sales.sales_summary(wh, sales.SalesFilter(month=2))
    plan = query._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "hashpartitioning(order_id" not in plan and plan.count("Bucketed: true") == 2
    assert "PartitionFilters: [isnotnull(purchase_month" in plan


def test_orphans_and_unknown_buyers_are_found_later(spark, tmp_path):
    """Orders before their customers, items before their orders; checks are not asked, as they refuse such records."""
    raw = micro.raw(
        spark,
        orders=micro.rows("orders", {}, order(2, "2018-02", "late"), order(3, "", "late")),
        order_items=micro.rows("order_items", {}, {"order_id": "o2"}, {"order_id": "o9"}, {"order_id": ""}),
    )
    store = TableStore(spark, f"{tmp_path}/out")
    for dataset, rows in raw.items():
        store.write_raw(dataset, rows, 0)
    enforce, build.quality.enforce = build.quality.enforce, lambda report: None
    try:
        build.refresh(store)
        write(store, "customers", 1, {"customer_id": "late", "customer_state": "rj"})
        write(store, "orders", 1, order(9, "2018-05"))
        build.refresh(store, ["customers", "orders"])
        assert "purchase_month=2018-01" in store.tables()["order_lines"].folders
        assert store.tables()["order_lines"].folders["purchase_month=2018-01"].endswith("/v0")
        assert_like_a_whole_build(spark, store, f"{tmp_path}/whole")
    finally:
        build.quality.enforce = enforce


def test_other_changes_and_failed_checks(spark, tmp_path, store):
    write(store, "orders", 1, order(2, "2018-02"))
    build.refresh(store, ["orders"])
    # Nothing new: nothing written.
    build.refresh(store, ["orders", "order_items"])
    kept = [n for n in build.TABLES if n != "dim_dates"]
    assert {n: store.tables(1)[n] for n in kept} == {n: store.tables(2)[n] for n in kept}
    # A batch that was stored again is not added once more.
    write(store, "orders", 1, order(2, "2018-04"))
    build.refresh(store, ["orders"])
    assert_like_a_whole_build(spark, store, f"{tmp_path}/whole")
    # A failed check leaves no trace, and the next attempt takes the batch as it is then.
    write(store, "order_payments", 2, {"payment_value": "-5.00"})
    with pytest.raises(QualityError):
        build.refresh(store, ["order_payments"])
    write(store, "order_payments", 2, {"payment_value": "5.00"})
    build.refresh(store, ["order_payments"])
    assert sorted(float(r.payment_value) for r in store.read("fct_payments").collect()) == [5.0, 100.0]


def test_many_folders_are_made_one(spark, store, monkeypatch):
    monkeypatch.setattr(increment, "MOST_FOLDERS", 2)
    for batch in (1, 2):
        write(store, "order_payments", batch, {"payment_sequential": str(batch + 1)})
        build.refresh(store, ["order_payments"])
    assert store.tables()["stg_payments"].parts is None and store.read("stg_payments").count() == 3


@pytest.mark.parametrize("seed", [1, 2])
def test_random_batches(spark, tmp_path, store, seed):
    random_ = random.Random(seed)
    months = [f"2018-{m:02}" for m in range(1, 7)]
    customers, orders = ["c1"], ["o1"]
    for batch in (1, 2, 3):
        new = [f"c{batch}{i}" for i in range(random_.randint(0, 2))]
        customers += new
        bought = [
            order(f"{batch}{i}", random_.choice(months), random_.choice(customers)) for i in range(random_.randint(0, 4))
        ]
        orders += [o["order_id"] for o in bought]
        pick = lambda n: [{"order_id": random_.choice(orders)} for _ in range(random_.randint(0, n))]
        given = {
            "customers": [{"customer_id": c, "customer_unique_id": f"p{c[-1]}"} for c in new],
            "orders": bought,
            "order_items": [o | {"price": f"{random_.randint(1, 90)}.50"} for o in pick(6)],
            "order_payments": [o | {"payment_value": f"{random_.randint(1, 90)}.25"} for o in pick(4)],
            "order_reviews": [o | {"review_score": str(random_.randint(1, 5))} for o in pick(3)],
        }
        touched = [d for d, changes in given.items() if changes]
        for dataset in touched:
            write(store, dataset, batch, *given[dataset])
        build.refresh(store, touched)
    assert_like_a_whole_build(spark, store, f"{tmp_path}/whole")
