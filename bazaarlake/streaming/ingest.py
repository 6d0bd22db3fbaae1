"""Continuous ingest of single records and refresh of the warehouse.

Records arrive as JSON lines ``{"dataset": ..., "data": {column: text}}`` in a
drop folder. Each micro-batch is split into valid records, which become a raw
batch, rejects, which are kept with a reason, and orders and items whose parent
has not come yet. These wait and are judged again with every later batch; then
everything downstream of the datasets touched is refreshed, by month where the
batch only adds records. A batch that is run again replaces its own records and
the tables are written anew from all records.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bazaarlake.plans.audit import PARENTS
from bazaarlake.plans.build import refresh
from bazaarlake.sources.schemas import COLUMNS, raw_columns
from bazaarlake.sources.storage import KEYS, TableStore

RECORD = "dataset string, data map<string,string>, _unreadable string"


def _declared() -> Column:
    chain = F
    for dataset, columns in COLUMNS.items():
        chain = chain.when(F.col("dataset") == dataset, F.array(*[F.lit(c) for c in columns]))
    return chain.otherwise(F.lit(None))


def _breaks_a_check() -> Column:
    """Of the checks between tables and reports, those a single record can fail."""
    paid = F.col("data")["payment_value"].try_cast("double")
    return (F.col("dataset") == "order_payments") & (paid < 0)


def with_reason(records: DataFrame) -> DataFrame:
    """Why a record is rejected, NULL if it is not."""
    declared = _declared()
    given = F.map_keys("data")
    missing = F.array_except(declared, given)
    extra = F.array_except(given, declared)
    reason = (
        F.when(F.col("dataset").isNull() | F.col("data").isNull(), F.lit("unreadable record"))
        .when(declared.isNull(), F.concat(F.lit("unknown dataset: "), "dataset"))
        .when(F.size(missing) > 0, F.concat(F.lit("missing columns: "), F.array_join(missing, ", ")))
        .when(F.size(extra) > 0, F.concat(F.lit("unknown columns: "), F.array_join(extra, ", ")))
        .when(_breaks_a_check(), F.lit("negative payment"))
    )
    return records.withColumn("reason", reason)


def _filled(name: str) -> Column:
    return F.nullif(F.col("data")[name], F.lit(""))


def _related(store: TableStore, judged: DataFrame, batch: int) -> DataFrame:
    """Valid records with a reason if their key is missing or taken, and ``waits`` if their parent is unknown.

    What earlier batches brought is asked of the key index, in the buckets that this batch's keys touch.
    """
    judged = judged.withColumn("waits", F.lit(False))
    for dataset in ("customers", "orders", "order_items"):
        own = F.col("reason").isNull() & (F.col("dataset") == dataset)
        if dataset in PARENTS:
            parent, column = PARENTS[dataset]
            wanted = judged.filter(own).select(_filled(column).alias("key"))
            known = store.known_keys(parent, wanted, batch).withColumnRenamed("key", "_parent")
            new = judged.filter((F.col("dataset") == parent) & F.col("reason").isNull() & ~F.col("waits"))
            known = known.unionByName(new.select(_filled(column).alias("_parent"))).distinct()
            judged = judged.withColumn("_wants", F.when(own, _filled(column))).join(
                known.withColumn("_known", F.lit(True)), F.col("_wants") == F.col("_parent"), "left"
            )
            judged = judged.withColumn(
                "reason", F.when(own & F.col("_wants").isNull(), F.lit(f"no {column}")).otherwise(F.col("reason"))
            ).withColumn("waits", F.col("waits") | (own & F.col("_wants").isNotNull() & F.col("_known").isNull()))
            judged = judged.drop("_wants", "_parent", "_known")
        if dataset in KEYS:
            column = KEYS[dataset]
            given = judged.filter(own).select(_filled(column).alias("key"))
            taken = store.known_keys(dataset, given, batch).withColumnRenamed("key", "_taken")
            judged = judged.withColumn("_key", F.when(own, _filled(column))).join(
                taken, F.col("_key") == F.col("_taken"), "left"
            )
            # Rows without a key are of other datasets, or rejected anyway: each is a group of its own.
            group = F.coalesce("_key", F.concat(F.lit("\0"), F.col("_at").cast("string")))
            first = F.row_number().over(Window.partitionBy(group).orderBy("waits", "_at")) == 1
            reason = (
                F.when(own & F.col("_key").isNull(), F.lit(f"no {column}"))
                .when(own & (F.col("_taken").isNotNull() | ~first), F.lit(f"repeated {column}"))
                .otherwise(F.col("reason"))
            )
            judged = judged.withColumn("reason", reason).drop("_key", "_taken")
    return judged


def _waiting(store: TableStore, batch: int) -> DataFrame | None:
    """Records that waited when a batch came."""
    found = store.waiting(batch, list(PARENTS))
    if not found:
        return None
    parts = []
    for dataset, rows in found.items():
        columns = raw_columns(dataset)
        data = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*columns))
        parts.append(
            rows.select(F.lit(dataset).alias("dataset"), data.alias("data"), F.lit(None).cast("string").alias("_unreadable"))
        )
    return reduce(DataFrame.unionByName, parts)


def store_batch(store: TableStore, records: DataFrame, batch: int) -> list[str]:
    """Write one batch of records; returns the datasets that got some."""
    earlier = _waiting(store, batch)
    if earlier is not None:
        records = earlier.unionByName(records)
    judged = with_reason(records).withColumn("_at", F.monotonically_increasing_id()).persist()
    related = judged
    try:
        if judged.filter(F.col("reason").isNull() & F.col("dataset").isin(*KEYS, *PARENTS)).isEmpty():
            related = judged.withColumn("waits", F.lit(False))
        else:
            related = _related(store, judged, batch).persist()
        waits = related.filter("reason IS NULL AND waits")
        valid = related.filter("reason IS NULL AND NOT waits")
        if earlier is not None or not waits.isEmpty():
            for dataset, (parent, _) in PARENTS.items():
                store.write_waiting(
                    dataset,
                    waits.filter(F.col("dataset") == dataset).select(
                        *(F.col("data")[c].alias(c) for c in raw_columns(dataset)),
                        F.lit(f"waits for its record in {parent}").alias("reason"),
                    ),
                    batch,
                )
        related.filter("reason IS NOT NULL").drop("waits", "_at").write.mode("overwrite").json(
            f"{store.root}/rejected/batch={batch}"
        )
        # At most one value per dataset, of which there are nine.
        touched = sorted(row[0] for row in valid.select("dataset").distinct().collect())
        for dataset in touched:
            rows = valid.filter(F.col("dataset") == dataset).select(
                [F.col("data")[c].alias(c) for c in raw_columns(dataset)]
            )
            store.write_raw(dataset, rows, batch)
        return touched
    finally:
        related.unpersist()
        judged.unpersist()


def start(
    store: TableStore,
    drop_folder: str,
    checkpoint: str,
    on_refresh: Callable[[], None] | None = None,
    max_files: int = 1000,
    available_now: bool = True,
) -> StreamingQuery:
    """Start the ingest; by default it ends when the folder is worked off.

    ``on_refresh`` runs after each rebuild, e.g. ``LiveReports.reload``. Records
    that would fail a check never come in. If one fails nevertheless, the fault
    is in earlier raw records: the stream ends with the error, and takes its
    batch up again when it is started after their repair.
    """
    source = (
        store.spark.readStream.schema(RECORD)
        .option("columnNameOfCorruptRecord", "_unreadable")
        .option("maxFilesPerTrigger", max_files)
        .json(drop_folder)
    )

    def on_batch(records: DataFrame, epoch: int) -> None:
        query_id = records.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        # The query id lives in the checkpoint: a batch that is run again after
        # a restart finds its number, another stream never does.
        batch = store.batch_of(f"stream {query_id} {epoch}")
        touched = store_batch(store, records, batch)
        if touched:
            refresh(store, touched)
            if on_refresh:
                on_refresh()

    writer = source.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
