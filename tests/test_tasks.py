"""Tasks are bounded by bytes and rows, so that a larger table gets more of them and no larger ones."""

import importlib
import re

import pytest

import compare
from bazaarlake import session
from bazaarlake.plans import build
from bazaarlake.plans.warehouse import Warehouse
from bazaarlake.sources.storage import TableStore
from bazaarlake.sources.tpch import TpchSource

FOLDER = "/root/testdata/sf0.001"
LINES = 6_000  # about
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
entry = importlib.import_module("__spark_entry__")


@pytest.fixture
def restored(spark):
    yield spark
    for key in (*session.TASK_BYTES, session.FIRST_PARTITIONS):
        spark.conf.unset(key)
    session.tune(spark)


def test_a_session_gets_small_tasks_and_keeps_smaller_ones(restored):
    for given, kept in (("64MB", 8 << 20), ("67108864b", 8 << 20), ("1g", 8 << 20), (str(2**40), 8 << 20), ("64k", 64 << 10)):
        restored.conf.set(ADVISORY, given)
        session.tune(restored)
        assert session._in_bytes(restored.conf.get(ADVISORY)) == kept
    assert int(restored.conf.get("spark.sql.files.maxPartitionBytes")) <= 16 << 20


@pytest.mark.parametrize(
    "name",
    [
        "ingest_impact",
        "insight_top_rated_seller",
        "insight_top_rated_seller_exact",
        "kpi_bands",
        "sales_summary",
        "sales_summary_exact",
        "seller_scores",
        "seller_scores_exact",
        "seller_tier_distribution",
        "seller_detail",
        "sales_map",
        "sales_map_exact",
        "map_layer",
        "filter_payment_type",
        "sales_seller_leaderboard",
        "seller_bands",
    ],
)
def test_lines_get_partitions_by_their_rows(restored, monkeypatch, name):
    expected = compare.spark_rows(entry.jobs()[name](Warehouse.from_tpch(restored, FOLDER)))
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    df = entry.jobs()[name](Warehouse.from_tpch(restored, FOLDER))
    plan = df._jdf.queryExecution().executedPlan().toString()
    parts = {int(n) for n in re.findall(r"hashpartitioning\(order_id#\d+, (\d+)\)", plan)}
    assert parts and min(parts) >= LINES // 100 - 2
    assert compare.spark_rows(df) == expected


def test_new_buckets_follow_the_rows(restored, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "TASK_ROWS", 400)
    store = TableStore(restored, f"{tmp_path}/rows")
    build.publish(store, TpchSource(restored, FOLDER))
    numbers = {t.buckets.number for t in store.tables().values() if t.buckets}
    assert len(numbers) == 1 and numbers.pop() >= LINES // 400 - 1


@pytest.mark.parametrize(
    "name",
    [
        "seller_performance_base",
        "seller_performance_base_exact",
        "seller_score_leaderboard",
        "sales_seller_leaderboard_exact",
    ],
)
def test_lines_of_sellers_get_partitions_by_their_rows(restored, monkeypatch, name):
    test_lines_get_partitions_by_their_rows(restored, monkeypatch, name)


def _seller_partitions(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {int(n) for n in re.findall(r"hashpartitioning\(seller_id#\d+, (\d+)\)", plan)}


def test_an_opened_store_gets_partitions_by_its_lines(restored, monkeypatch, tmp_path):
    store = TableStore(restored, f"{tmp_path}/opened")
    build.publish(store, TpchSource(restored, FOLDER))
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    restored.conf.unset(session.FIRST_PARTITIONS)
    parts = _seller_partitions(entry.jobs()["sales_seller_leaderboard"](build.open_warehouse(store)))
    assert parts and min(parts) >= LINES // 100 - 2


def test_a_whole_build_of_a_grown_store_gets_more_buckets(restored, monkeypatch, tmp_path):
    store = TableStore(restored, f"{tmp_path}/grown")
    build.publish(store, TpchSource(restored, FOLDER))
    monkeypatch.setattr(session, "TASK_ROWS", 400)
    build.publish(store, TpchSource(restored, FOLDER))
    numbers = {t.buckets.number for t in store.tables().values() if t.buckets}
    assert len(numbers) == 1 and numbers.pop() >= LINES // 400 - 1


@pytest.mark.parametrize(
    "name",
    [
        "kpi_bands",
        "sales_summary",
        "sales_summary_exact",
        "seller_scores_exact",
        "seller_tier_distribution",
        "seller_detail",
        "seller_performance_base_exact",
        "seller_score_leaderboard",
        "sales_map_exact",
        "filter_payment_type",
        "seller_bands",
        "map_layer",
    ],
)
def test_a_smaller_table_before_leaves_no_few_partitions(more_partitions, monkeypatch, name):
    # A smaller table left a first number that is below the session's number of partitions, and counts.
    more_partitions.conf.set(session.FIRST_PARTITIONS, "2")
    test_lines_get_partitions_by_their_rows(more_partitions, monkeypatch, name)


@pytest.fixture
def more_partitions(restored):
    given = restored.conf.get(session.PARTITIONS)
    restored.conf.set(session.PARTITIONS, "200")
    yield restored
    restored.conf.set(session.PARTITIONS, given)


def test_the_number_that_spark_starts_a_shuffle_with(more_partitions):
    for first, number in ((None, 200), ("7", 7), ("300", 300)):
        more_partitions.conf.unset(session.FIRST_PARTITIONS)
        if first:
            more_partitions.conf.set(session.FIRST_PARTITIONS, first)
        plan = more_partitions.range(10).selectExpr("id % 3 AS k").groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
        assert session.shuffle_tasks(more_partitions) == number == int(re.search(r"hashpartitioning\(k#\d+L?, (\d+)\)", plan)[1])
    more_partitions.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    assert session.shuffle_tasks(more_partitions) == 200
    session.tune(more_partitions)


@pytest.mark.parametrize(
    "name",
    [
        "sales_summary_exact",
        "seller_scores_exact",
        "seller_tier_distribution",
        "seller_detail",
        "seller_performance_base_exact",
        "seller_score_leaderboard",
        "sales_map_exact",
        "filter_payment_type",
        "seller_bands",
    ],
)
def test_settings_put_back_between_queries_leave_no_large_tasks(restored, monkeypatch, name):
    # The warehouse of the first query is kept, and the second one measures nothing anew.
    expected = compare.spark_rows(entry.queries()[name](restored, FOLDER))
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    for key in (*session.TASK_BYTES, session.FIRST_PARTITIONS):
        restored.conf.unset(key)
    df = entry.queries()[name](restored, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    parts = {int(n) for n in re.findall(r"hashpartitioning\((?:order|seller)_id#\d+, (\d+)\)", plan)}
    assert parts and min(parts) >= LINES // 100 - 2
    assert all(session._in_bytes(restored.conf.get(key)) <= most for key, most in session.TASK_BYTES.items())
    assert compare.spark_rows(df) == expected


def test_settings_put_back_leave_an_opened_store_its_partitions(restored, monkeypatch, tmp_path):
    store = TableStore(restored, f"{tmp_path}/put_back")
    build.publish(store, TpchSource(restored, FOLDER))
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    wh = build.open_warehouse(store)
    restored.conf.unset(session.FIRST_PARTITIONS)
    parts = _seller_partitions(entry.jobs()["sales_seller_leaderboard"](wh))
    assert parts and min(parts) >= LINES // 100 - 2
