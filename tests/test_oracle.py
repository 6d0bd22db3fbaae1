"""Every registered query against its SQL, on the smallest tables."""

import importlib

import pytest

import compare
from bazaarlake.plans import build
from bazaarlake.sources import records
from bazaarlake.sources.storage import TableStore
from bazaarlake.sources.tpch import TpchSource

FOLDER = "/root/testdata/sf0.001"
entry = importlib.import_module("__spark_entry__")
QUERIES = {name: query for name, query in entry.queries().items() if name in entry.jobs()}
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    assert compare.spark_rows(QUERIES[name](spark, FOLDER)) == compare.duck_rows(duck, SQL[name])


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The same tables by way of the store: raw text, stored tables and reports."""
    store = TableStore(spark, str(tmp_path_factory.mktemp("store")))
    for dataset, rows in TpchSource(spark, FOLDER).items():
        store.write_raw(dataset, records.validate(dataset, rows), 0)
    build.refresh(store)
    return build.open_warehouse(store)


# Their order of entry is that of the typed rows, which text doesn't keep.
BY_ENTRY = {"dataset_sample", "products_recent", "sellers_recent"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - BY_ENTRY))
def test_stored_warehouse_matches_sql(stored, duck, name):
    assert compare.spark_rows(entry.jobs()[name](stored)) == compare.duck_rows(duck, SQL[name])


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
