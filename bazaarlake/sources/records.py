"""Catalogue, counts, samples, validation and appends of raw datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.operators.filters import bounded
from bazaarlake.sources.schemas import COLUMNS, INGEST_SEQ, raw_columns


def dataset_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Every dataset's location and columns, in order."""
    rows = [
        (dataset, f"{root}/{dataset}", position, column)
        for dataset, columns in COLUMNS.items()
        for position, column in enumerate(columns, start=1)
    ]
    return spark.createDataFrame(rows, "dataset string, path string, position int, column string")


def raw_row_counts(raw: dict[str, DataFrame]) -> DataFrame:
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(dataset).alias("dataset"), "rows")
        for dataset, df in raw.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def dataset_sample(raw: dict[str, DataFrame], dataset: str, limit: int = 5) -> DataFrame:
    """The first rows of a dataset in the order they were entered."""
    bounded("limit", limit, 1, 50)
    columns = raw_columns(dataset)
    return raw[dataset].orderBy(INGEST_SEQ).limit(limit).select(columns)


def validate(dataset: str, records: DataFrame) -> DataFrame:
    """Records with exactly the dataset's columns, in declared order.

    Also the preview of a write: nothing is stored.
    """
    columns = raw_columns(dataset)
    given = [c for c in records.columns if c != INGEST_SEQ]
    missing = [c for c in columns if c not in given]
    extra = [c for c in given if c not in columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if extra:
        raise ValueError(f"unknown columns: {', '.join(extra)}")
    return records.select([F.col(c).cast("string").alias(c) for c in columns])
