"""Hand-made raw text rows for the cases the generated tables do not reach."""

from __future__ import annotations

import csv
import os

from bazaarlake.plans.warehouse import Warehouse
from bazaarlake.sources.schemas import COLUMNS, INGEST_SEQ

DEFAULTS = {
    "customers": ("c1", "p1", "01151", "Campinas", "sp"),
    "orders": (
        "o1", "c1", "Delivered", "2018-01-10 10:00:00", "2018-01-10 11:00:00",
        "2018-01-12 00:00:00", "2018-01-20 22:00:00", "2018-02-01 00:00:00",
    ),
    "order_items": ("o1", "1", "x1", "s1", "2018-01-15 00:00:00", "90.00", "10.00"),
    "order_payments": ("o1", "1", "Credit_Card", "2", "100.00"),
    "order_reviews": ("r1", "o1", "5", "", "", "2018-01-25 00:00:00", "2018-01-26 00:00:00"),
    "products": ("x1", "flores", "10", "20", "1", "500", "2", "3", "4"),
    "sellers": ("s1", "13023", "Sao Paulo", "sp"),
    "geolocation": ("01151", "-23.5", "-46.6", "Campinas", "sp"),
    "category_translation": ("flores", "flowers"),
}


def rows(dataset: str, *changes: dict) -> list[tuple]:
    """One row per dict of changed columns."""
    base = dict(zip(COLUMNS[dataset], DEFAULTS[dataset]))
    return [tuple({**base, **change}.values()) for change in changes]


def raw(spark, **datasets):
    """Raw DataFrames; datasets not given hold their one default row."""
    result = {}
    for dataset, columns in COLUMNS.items():
        data = datasets.get(dataset, [DEFAULTS[dataset]])
        schema = ", ".join(f"{c} string" for c in columns) + f", {INGEST_SEQ} bigint"
        numbered = [(*row, i) for i, row in enumerate(data)]
        result[dataset] = spark.createDataFrame(numbered, schema)
    return result


def warehouse(spark, **datasets) -> Warehouse:
    return Warehouse(raw=raw(spark, **datasets))


def write_csvs(folder: str, **datasets) -> None:
    os.makedirs(folder, exist_ok=True)
    for dataset, columns in COLUMNS.items():
        with open(f"{folder}/{dataset}.csv", "w", newline="", encoding="utf-8") as handle:
            writer = csv.writer(handle)
            writer.writerow(columns)
            writer.writerows(datasets.get(dataset, [DEFAULTS[dataset]]))
