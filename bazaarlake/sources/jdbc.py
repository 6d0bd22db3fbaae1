"""Tables of a relational database, read in parallel ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str] | None = None,
    split_on: str | None = None,
    lower: int | str | None = None,
    upper: int | str | None = None,
    partitions: int = 1,
) -> DataFrame:
    """Read a table; with ``split_on`` (a number, date or timestamp column)
    as ``partitions`` concurrent range queries."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if split_on:
        reader = (
            reader.option("partitionColumn", split_on)
            .option("lowerBound", lower)
            .option("upperBound", upper)
            .option("numPartitions", partitions)
        )
    return reader.options(**(properties or {})).load()


def write_table(
    df: DataFrame,
    url: str,
    table: str,
    properties: dict[str, str] | None = None,
    mode: str = "overwrite",
) -> None:
    # Keeps the table and its grants when replacing the rows.
    writer = df.write.format("jdbc").option("url", url).option("dbtable", table)
    writer.option("truncate", True).options(**(properties or {})).mode(mode).save()
