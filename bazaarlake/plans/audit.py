"""Checks of a batch on its own rows, before anybody sees them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarlake.plans.quality import QualityError
from bazaarlake.sources.schemas import raw_columns
from bazaarlake.sources.storage import KEYS, TableStore

# Dataset and column that a dataset refers to, as the quality checks have them; parents first.
PARENTS = {"orders": ("customers", "customer_id"), "order_items": ("orders", "order_id")}
AUDITED = {*KEYS, *PARENTS, "order_payments"}


class RefusedBatch(QualityError):
    """A batch would fail the quality checks; ``rows`` holds the rows at fault, each with its reason."""

    def __init__(self, rows: DataFrame, failures: list[str]):
        super().__init__(failures)
        self.rows = rows


def faults(store: TableStore, dataset: str, rows: DataFrame, batch: int) -> DataFrame:
    """Rows of a batch that would fail a check, with the reason; the work grows with the batch.

    What other batches brought is asked of the key index, in the buckets that the batch touches. A key is
    at fault if it is missing, known already, or not the first in the batch; a reference if it is missing or
    unknown; a payment if it is negative. Rows have the raw columns and their number in the batch.
    """
    judged = rows.withColumn("reason", F.lit(None).cast("string"))
    if dataset == "order_payments":
        judged = judged.withColumn("reason", F.when(F.col("payment_value").try_cast("double") < 0, "negative payment"))
    if dataset in PARENTS:
        parent, column = PARENTS[dataset]
        wanted = rows.select(F.nullif(column, F.lit("")).alias("key"))
        known = store.known_keys(parent, wanted, -1).select(F.col("key").alias("_known"))
        judged = (
            judged.withColumn("_wants", F.nullif(column, F.lit("")))
            .join(known, F.col("_wants") == F.col("_known"), "left")
            .withColumn(
                "reason",
                F.when(F.col("_wants").isNull(), F.lit(f"no {column}"))
                .when(F.col("_known").isNull(), F.lit(f"unknown {column}"))
                .otherwise(F.col("reason")),
            )
            .drop("_wants", "_known")
        )
    if dataset in KEYS:
        column = KEYS[dataset]
        key = F.nullif(column, F.lit(""))
        taken = store.known_keys(dataset, rows.select(key.alias("key")), batch).select(F.col("key").alias("_taken"))
        # Rows without a key are each a group of their own.
        group = F.coalesce("_key", F.concat(F.lit("\0"), F.col("_row_number").cast("string")))
        first = F.row_number().over(Window.partitionBy(group).orderBy("_row_number")) == 1
        judged = (
            judged.withColumn("_key", key)
            .join(taken, F.col("_key") == F.col("_taken"), "left")
            .withColumn(
                "reason",
                F.when(F.col("_key").isNull(), F.lit(f"no {column}"))
                .when(F.col("_taken").isNotNull() | ~first, F.lit(f"repeated {column}"))
                .otherwise(F.col("reason")),
            )
        )
    return judged.filter("reason IS NOT NULL").select(*raw_columns(dataset), "reason")


def admit(store: TableStore, dataset: str, rows: DataFrame, batch: int) -> None:
    """Stage a batch, audit it, and only then make it raw records.

    A refused batch stays below ``staged``, where no reader looks, until it is handed in again; tables, raw
    records and key index are as before.
    """
    staged = store.stage(dataset, rows, batch)
    if dataset in AUDITED:
        bad = faults(store, dataset, staged, batch)
        # At most one row per reason.
        reasons = sorted(r["reason"] for r in bad.select("reason").distinct().collect())
        if reasons:
            raise RefusedBatch(bad, reasons)
    store.publish_staged(dataset, batch)
