"""Raw datasets as CSV files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from bazaarlake.sources.schemas import DATASETS, raw_schema

# File, folder or glob of each dataset below the data folder; pass another
# mapping for other names, e.g. {"orders": "*_orders_dataset.csv", ...}.
FILES = {dataset: f"{dataset}.csv" for dataset in DATASETS}

# Datasets whose free text may run over several lines. Such files cannot be
# split, so large deliveries of them should come as many files; all other
# datasets are split however large a file is.
MULTI_LINE = {"order_reviews"}


def scan_csv(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """All-text scan: header and a byte-order mark skipped, empty cells NULL,
    short rows padded, surplus cells ignored."""
    return (
        spark.read.schema(raw_schema(dataset))
        .option("header", True)
        .option("encoding", "UTF-8")
        .option("multiLine", dataset in MULTI_LINE)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .csv(path)
    )


def scan_folder(
    spark: SparkSession, folder: str, files: Mapping[str, str] = FILES
) -> dict[str, DataFrame]:
    """All nine datasets; a missing one is named before anything is read."""
    raw = {}
    for dataset in DATASETS:
        path = f"{folder}/{files[dataset]}"
        try:
            raw[dataset] = scan_csv(spark, path, dataset)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            raise FileNotFoundError(f"missing required file: {path}") from error
    return raw
