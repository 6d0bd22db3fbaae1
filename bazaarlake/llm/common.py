"""What the text operators share: tables between jobs, row keys, distributed ranks and running sums."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from types import ModuleType
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run without these characters, which are also what ``bytes.split()`` splits at.
WORD = r"[^\x20\x09-\x0D]+"

#: Stands for a NULL id, so that it sorts below every other and joins like a value.
NO_ID = -(2**63)


#: Rows in an Arrow batch that Python makes.
CHUNK = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written between jobs, below the folder that the cluster names in spark.checkpoint.dir.

    A table cuts lineage: a lost executor costs one job's tasks, never the jobs before. Without the setting
    a local session gets a folder of its own and any other master is an error. Everything is deleted when
    the session's JVM ends, superseded tables earlier (``drop``).
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if base is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="scratch-")
        self.spark = spark
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)
        self._fs.deleteOnExit(path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it back."""
        schema = df.schema
        df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        """Delete a table that no later job reads."""
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"), True)


def id_key(name: str = "doc_id") -> Column:
    """An id as a long that is never NULL; ``id_of`` turns it back."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def id_of(key: str) -> Column:
    return F.when(F.col(key) != NO_ID, F.col(key))


def with_offsets(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column], values: dict[str, Column]
) -> DataFrame:
    """Running sums before each row, per ``keys``, in the order of (bucket, order).

    Rows of one key may be a third of the table, so nothing is sorted per key: a window sums inside each
    (key, bucket), a second one over the few bucket totals of a key adds what lies before. Buckets must be
    consistent with the wanted order. For each name in ``values`` adds <name>_before and <name>_total.
    """
    valued = df.withColumns({f"_v_{n}": v.cast("long") for n, v in values.items()})
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    none = F.lit(0).cast("long")
    totals = (
        valued.groupBy(*keys, bucket)
        .agg(*(F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values))
        .select(
            *(F.col(k).alias(f"_k_{k}") for k in (*keys, bucket)),
            *(F.coalesce(F.sum(f"_s_{n}").over(across), none).alias(f"_b_{n}") for n in values),
            *(F.sum(f"_s_{n}").over(whole).alias(f"{n}_total") for n in values),
        )
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in (*keys, bucket)]
    return (
        valued.withColumns({f"_i_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), none) for n in values})
        .join(totals, same)
        .select(
            *(F.col(c) for c in df.columns),
            *((F.col(f"_i_{n}") + F.col(f"_b_{n}")).alias(f"{n}_before") for n in values),
            *(f"{n}_total" for n in values),
        )
    )


def global_rank(df: DataFrame, order: Sequence[Column], scratch: Scratch, name: str) -> DataFrame:
    """Rows with their place (from 0) in the whole table's order, without one task seeing them all.

    Range partitions are sorted and written with the place inside their partition; one row per partition
    then gives the places before it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = scratch.keep(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .select("*", F.monotonically_increasing_id().alias("_at")),
        name,
    ).withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    return (
        placed.join(F.broadcast(starts), F.col("_part") == F.col("_p"))  # one row per partition
        .withColumn("rank", F.col("_start") + F.col("_at").bitwiseAND(2**33 - 1))
        .drop("_at", "_part", "_p", "_start")
    )


def batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size."""

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == CHUNK:
            yield batch()
            held = []
    if held:
        yield batch()


def of_worker(key: tuple, make: Callable[[], Any]) -> Any:
    """What a worker process makes once and keeps for its later tasks.

    Functions reach the workers by value, with globals of their own each time; a module lasts.
    """
    kept = sys.modules.setdefault("_llm_worker", ModuleType("_llm_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]
