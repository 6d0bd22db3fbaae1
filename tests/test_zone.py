"""Figures do not depend on the session's time zone."""

import importlib

import pytest

import compare
from bazaarlake.plans.warehouse import Warehouse

FOLDER = "/root/testdata/sf0.001"
entry = importlib.import_module("__spark_entry__")


@pytest.mark.parametrize("name", ["fct_orders", "dim_dates", "seller_scores", "filter_everything", "delivery_lanes"])
def test_zone_with_clock_changes(spark, name):
    duck = compare.connect(FOLDER)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        found = compare.spark_rows(entry.jobs()[name](Warehouse.from_tpch(spark, FOLDER)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found == compare.duck_rows(duck, entry.oracle_sql()[name])
