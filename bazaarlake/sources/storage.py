"""Parquet storage of raw batches and versioned warehouse tables.

Below one root folder:

``raw/<dataset>/batch=<n>``    records of one batch; batch 0 is the first
                               load and is never written again, so it serves
                               as the copy from before any append
``tables/<table>/v<n>``        a table as built for version n, or what that version added to it: a table
                               is one folder, or several (rows added since), or months from several
``manifests/version=<n>``      folder, schema and layout of each table as of version n
``batches``                    the number given to each delivery
``keys/<dataset>/batch=<n>``   keys that a batch brought, by buckets of their hash: what a new batch
                               refers to or repeats is looked up in the buckets that it touches
``staged/<dataset>/batch=<n>`` rows that wait for their audit, or were refused; no reader sees them
``set_aside/batch=<n>``        records of a batch that failed a check, and why, or all
                               records that wait for others since a stream's batch

A version becomes current when its manifest is committed, after all of its
tables are complete: readers see the old tables or the new ones, never a gap.
A delivery keeps its batch number when it is stored again, and a batch is
replaced as a whole, so repeated attempts are safe. There is one writer.
"""

from __future__ import annotations

import hashlib
import json
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlake.sources.schemas import DATASETS, INGEST_SEQ, raw_columns, raw_schema

_ROW = "_row_number"
# Key of the datasets that others refer to.
KEYS = {"customers": "customer_id", "orders": "order_id"}
# Fixed value: buckets of the key index.
KEY_BUCKETS = 256
# Fixed value: folder name of Spark for the partition without a value.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
# Partition column, in the catalog only, of the folders that rows were added in.
ADDED = "_added"
_MANIFEST = "table string, path string, schema string, layout string, parts string"
_BATCHES = "delivery string, batch bigint"


class Buckets(NamedTuple):
    """Files dealt out by a hash of a key: rows of one key are in one bucket, and tables with as many buckets
    of the same key meet without a shuffle. The table is partitioned by another column within, or by none."""

    key: str
    number: int
    partition_by: str | None = None


class Stored(NamedTuple):
    """Where a table is and what it looks like, so that opening it neither
    reads a file nor fails on a table without rows."""

    path: str
    schema: str
    layout: str | None = None
    parts: str | None = None

    @property
    def buckets(self) -> Buckets | None:
        return Buckets(*json.loads(self.layout)) if self.layout else None

    @property
    def folders(self) -> list[str] | dict[str, str]:
        """Where the rows are: folders that each hold some, or by partition (``column=value``) the folder it is in."""
        return json.loads(self.parts) if self.parts else [self.path]


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- raw records --------------------------------------------------------

    def write_raw(self, dataset: str, records: DataFrame, batch: int) -> None:
        """Store a batch of records, replacing an earlier attempt at it."""
        numbered = records.select(
            *raw_columns(dataset), F.monotonically_increasing_id().alias(_ROW)
        )
        path = f"{self.root}/raw/{dataset}/batch={batch}"
        numbered.write.mode("overwrite").parquet(path)
        self._index_keys(dataset, batch)

    def stage(self, dataset: str, records: DataFrame, batch: int) -> DataFrame:
        """Store rows where only an audit sees them; numbered and typed like raw records."""
        numbered = records.select(*raw_columns(dataset), F.monotonically_increasing_id().alias(_ROW))
        path = f"{self.root}/staged/{dataset}/batch={batch}"
        schema = numbered.schema
        numbered.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def publish_staged(self, dataset: str, batch: int) -> None:
        """Make staged rows the raw records of their batch, replacing an earlier attempt at it."""
        path, files = self._files()
        staged, raw = (path(f"{self.root}/{place}/{dataset}/batch={batch}") for place in ("staged", "raw"))
        files.delete(raw, True)
        files.mkdirs(raw.getParent())
        if not files.rename(staged, raw):
            raise OSError(f"batch {batch} of {dataset} can't be published")
        self._index_keys(dataset, batch)

    # -- the key index ------------------------------------------------------

    def _index_keys(self, dataset: str, batch: int) -> None:
        if dataset not in KEYS:
            return
        rows = self.spark.read.schema(raw_schema(dataset)).parquet(f"{self.root}/raw/{dataset}/batch={batch}")
        key = F.nullif(KEYS[dataset], F.lit("")).alias("key")
        (
            rows.select(key)
            .filter("key IS NOT NULL")
            .withColumn("bucket", _bucket_of("key"))
            .distinct()
            .hint("rebalance", "bucket")
            .sortWithinPartitions("bucket", "key")
            .write.mode("overwrite")
            .partitionBy("bucket")
            .parquet(f"{self.root}/keys/{dataset}/batch={batch}")
        )

    def known_keys(self, dataset: str, keys: DataFrame, without_batch: int) -> DataFrame:
        """Those of ``keys`` (one column, key) that other batches brought, each once.

        Only the buckets that the keys fall into are read; their numbers, KEY_BUCKETS at most, come to
        the driver so that the scan leaves the others out.
        """
        path, files = self._files()
        top = f"{self.root}/keys/{dataset}"
        if not files.exists(path(top)):
            # A store from before the index, or nothing has come in yet.
            raw = path(f"{self.root}/raw/{dataset}")
            for f in files.listStatus(raw) if files.exists(raw) else ():
                self._index_keys(dataset, int(f.getPath().getName().removeprefix("batch=")))
        if not files.exists(path(top)):
            return self.spark.createDataFrame([], "key string")
        wanted = keys.filter("key IS NOT NULL").distinct()
        touched = [row[0] for row in wanted.select(_bucket_of("key")).distinct().collect()]
        index = self.spark.read.schema("key string, batch bigint, bucket int").parquet(top)
        own = index.filter(F.col("bucket").isin(touched) & (F.col("batch") != without_batch))
        return own.join(wanted, "key", "left_semi").select("key").distinct()

    def batches(self) -> dict[str, dict[int, str]]:
        """The batches of each dataset, with a digest of their files' names: a batch stored again has others."""
        path, files = self._files()
        found: dict[str, dict[int, str]] = {}
        for dataset in DATASETS:
            top = path(f"{self.root}/raw/{dataset}")
            found[dataset] = {}
            for folder in files.listStatus(top) if files.exists(top) else ():
                names = sorted(f.getPath().getName() for f in files.listStatus(folder.getPath()))
                number = int(folder.getPath().getName().removeprefix("batch="))
                found[dataset][number] = hashlib.sha256("/".join(names).encode()).hexdigest()[:16]
        return found

    def raw(
        self,
        dataset: str,
        before_batch: int | None = None,
        without_batch: int | None = None,
        batches: list[int] | None = None,
    ) -> DataFrame:
        """All records of a dataset, or those from before a batch, or those of other batches, or of some."""
        schema = T.StructType(raw_schema(dataset).fields)
        schema.add(_ROW, T.LongType()).add("batch", T.LongType())
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.root}/raw/{dataset}")
        except AnalysisException as error:
            if not _missing(error):
                raise
            # Nothing of this dataset has come in yet.
            rows = self.spark.createDataFrame([], schema)
        if before_batch is not None:
            rows = rows.filter(F.col("batch") < before_batch)
        if without_batch is not None:
            rows = rows.filter(F.col("batch") != without_batch)
        if batches is not None:
            rows = rows.filter(F.col("batch").isin(batches))
        order = F.struct("batch", _ROW).alias(INGEST_SEQ)
        return rows.select(*raw_columns(dataset), order)

    def all_raw(self, before_batch: int | None = None) -> dict[str, DataFrame]:
        return {dataset: self.raw(dataset, before_batch) for dataset in DATASETS}

    def batch_of(self, delivery: str) -> int:
        """Number of a delivery: the one it has, or the next free one."""
        path = f"{self.root}/batches"
        try:
            known = self.spark.read.schema(_BATCHES).parquet(path)
            own = F.min(F.when(F.col("delivery") == delivery, F.col("batch")))
            given, last = known.agg(own, F.max("batch")).first()
        except AnalysisException as error:
            if not _missing(error):
                raise
            given, last = None, None
        if given is not None:
            return given
        batch = 0 if last is None else last + 1
        row = self.spark.createDataFrame([(delivery, batch)], _BATCHES)
        row.coalesce(1).write.mode("append").parquet(path)
        return batch

    def _files(self):
        """Hadoop's Path and the file system of the store."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write_waiting(self, dataset: str, rows: DataFrame, batch: int) -> None:
        """All records of a dataset that wait for others after a batch, each with the reason."""
        rows.write.mode("overwrite").parquet(f"{self.root}/set_aside/batch={batch}/{dataset}")

    def waiting(self, before_batch: int, datasets: list[str]) -> dict[str, DataFrame]:
        """Records that waited after the last batch before this one; none if that left nothing written."""
        path, files = self._files()
        top = path(f"{self.root}/set_aside")
        if not files.exists(top):
            return {}
        # A batch that was set aside as a whole has its reason in a folder.
        batches = [
            int(name.removeprefix("batch="))
            for f in files.listStatus(top)
            if (name := f.getPath().getName()).startswith("batch=") and not files.exists(path(f"{self.root}/set_aside/{name}/reason"))
        ]
        last = max((b for b in batches if b < before_batch), default=None)
        if last is None:
            return {}
        return {
            d: self.spark.read.schema(raw_schema(d)).parquet(f"{self.root}/set_aside/batch={last}/{d}") for d in datasets
        }

    def set_aside(self, batch: int, reason: str) -> None:
        """Take a batch out of the raw records; it stays below ``set_aside``, with the reason."""
        path, files = self._files()
        aside = f"{self.root}/set_aside/batch={batch}"
        if files.exists(path(aside)) and not files.exists(path(f"{aside}/reason")):
            raise OSError(f"records of batch {batch} wait in {aside}")
        self.spark.createDataFrame([(reason,)], "reason string").coalesce(1).write.mode("overwrite").json(
            f"{aside}/reason"
        )
        for dataset in DATASETS:
            files.delete(path(f"{self.root}/keys/{dataset}/batch={batch}"), True)
            rows = path(f"{self.root}/raw/{dataset}/batch={batch}")
            if files.exists(rows) and not files.rename(rows, path(f"{aside}/{dataset}")):
                raise OSError(f"batch {batch} of {dataset} can't be set aside")

    # -- tables -------------------------------------------------------------

    def write_table(
        self,
        table: str,
        df: DataFrame,
        version: int,
        partition_by: str | None = None,
        lookup: str | None = None,
        buckets: Buckets | None = None,
    ) -> Stored:
        """Write a table; rows of a file are in the order of the ``lookup`` key, or of the buckets' key."""
        path = f"{self.root}/tables/{table}/v{version}"
        schema = df.schema.json()
        if buckets:
            return self._write_buckets(df, Stored(path, schema, json.dumps(buckets)))
        if partition_by:
            # Even files however uneven the partitions, few files per partition.
            df = df.hint("rebalance", partition_by)
        if lookup:
            df = df.sortWithinPartitions(*([partition_by] if partition_by else []), lookup)
        writer = df.write.mode("overwrite")
        if lookup:
            writer = writer.option(f"parquet.bloom.filter.enabled#{lookup}", "true")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
        return Stored(path, schema)

    def _write_buckets(self, df: DataFrame, stored: Stored) -> Stored:
        """Write a table in buckets: a task per bucket, one file per bucket and partition.

        A key is found by its bucket and the order in the file; a Bloom filter in each of these many files
        would be larger than the rows.
        """
        key, number, partition_by = stored.buckets
        writer = (
            # As Spark deals rows out to buckets; a task then writes one bucket.
            df.repartition(number, key)
            .write.mode("overwrite")
            .option("path", stored.path)
            .bucketBy(number, key)
            .sortBy(key)
        )
        if partition_by:
            writer = writer.partitionBy(partition_by)
        self.spark.sql(f"DROP TABLE IF EXISTS {_registered(stored)}")
        writer.saveAsTable(_registered(stored))
        return stored

    def add_rows(self, table: str, df: DataFrame, version: int, old: Stored, lookup: str | None = None) -> Stored:
        """A table with further rows, in a folder of their own; its other folders stay."""
        own = self.write_table(table, df, version, None, lookup, old.buckets)
        return self._changed(Stored(own.path, old.schema, old.layout, json.dumps([*old.folders, own.path])))

    def replace_partitions(
        self,
        table: str,
        df: DataFrame,
        version: int,
        old: Stored,
        partition_by: str,
        values: set,
        lookup: str | None = None,
    ) -> Stored:
        """A partitioned table with the partitions of some values as in ``df``; the others keep their files."""
        folders = old.folders
        if isinstance(folders, list):
            folders = {name: old.path for name in self._partitions(old.path, partition_by)}
        own = self.write_table(table, df, version, partition_by, lookup, old.buckets)
        replaced = {f"{partition_by}={NO_VALUE if value is None else value}" for value in values}
        kept = {name: folder for name, folder in folders.items() if name not in replaced}
        written = {name: own.path for name in self._partitions(own.path, partition_by)}
        return self._changed(Stored(own.path, old.schema, old.layout, json.dumps(kept | written, sort_keys=True)))

    def _changed(self, stored: Stored) -> Stored:
        """A table whose files an earlier attempt may have entered in the catalog."""
        self.spark.sql(f"DROP TABLE IF EXISTS {_registered(stored)}")
        return stored

    def _partitions(self, folder: str, column: str) -> list[str]:
        path, files = self._files()
        names = [f.getPath().getName() for f in files.listStatus(path(folder))]
        return sorted(name for name in names if name.startswith(f"{column}="))

    def _open_registered(self, stored: Stored) -> DataFrame:
        """A table in buckets, or of partitions from several folders. Only the catalog tells Spark of either, so
        it is entered there, as an external table under a name made of its folders; no other session needs
        the entry."""
        name, folders = _registered(stored), stored.folders
        schema = T.StructType.fromJson(json.loads(stored.schema))
        if not self.spark.catalog.tableExists(name):
            columns, partition_by = schema.toDDL(), stored.buckets.partition_by if stored.buckets else None
            if isinstance(folders, dict) and folders:
                partition_by = next(iter(folders)).split("=")[0]
            elif len(folders) > 1:
                # Folders of added rows are partitions by their number.
                partition_by, columns = ADDED, f"{columns}, {ADDED} INT"
            layout = f"PARTITIONED BY ({partition_by})" if partition_by else ""
            if stored.buckets:
                key, number, _ = stored.buckets
                layout += f" CLUSTERED BY ({key}) SORTED BY ({key}) INTO {number} BUCKETS"
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet {layout} LOCATION '{stored.path}'"
            )
            if isinstance(folders, dict):
                places = {name_.split("=")[1]: f"{folder}/{name_}" for name_, folder in folders.items()}
            else:
                places = {str(at): folder for at, folder in enumerate(folders)} if len(folders) > 1 else {}
            if places:
                self.spark.sql(
                    f"ALTER TABLE {name} ADD IF NOT EXISTS "
                    + " ".join(
                        f"PARTITION ({partition_by}={'NULL' if value == NO_VALUE else repr(value)}) LOCATION '{place}'"
                        for value, place in places.items()
                    )
                )
            elif partition_by:
                self.spark.catalog.recoverPartitions(name)
        return self.spark.table(name).select(schema.names)

    def commit(self, tables: dict[str, Stored], version: int) -> None:
        """Make a set of table folders the current version."""
        rows = self.spark.createDataFrame([(name, *t) for name, t in sorted(tables.items())], _MANIFEST)
        path = f"{self.root}/manifests/version={version}"
        rows.coalesce(1).write.mode("overwrite").parquet(path)

    def _manifests(self) -> DataFrame | None:
        schema = f"{_MANIFEST}, version bigint"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/manifests")
        except AnalysisException as error:
            if _missing(error):
                return None
            raise

    def version(self) -> int | None:
        """Current version, None before the first build."""
        manifests = self._manifests()
        return None if manifests is None else manifests.agg(F.max("version")).first()[0]

    def tables(self, version: int | None = None) -> dict[str, Stored]:
        """Every table of a version, by default of the current one."""
        version = self.version() if version is None else version
        if version is None:
            return {}
        rows = self._manifests().filter(F.col("version") == version).collect()
        return {row["table"]: Stored(row["path"], row["schema"], row["layout"], row["parts"]) for row in rows}

    def open(self, stored: Stored) -> DataFrame:
        folders = stored.folders
        if stored.layout or isinstance(folders, dict):
            return self._open_registered(stored)
        schema = T.StructType.fromJson(json.loads(stored.schema))
        return self.spark.read.schema(schema).parquet(*folders).select(schema.names)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        tables = self.tables(version)
        if table not in tables:
            raise ValueError(f"no table {table} in the store")
        return self.open(tables[table])


def _bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int").alias("bucket")


def _registered(stored: Stored) -> str:
    """Name in the catalog of the table in some folders."""
    place = f"{stored.path}{stored.parts or ''}"
    return f"spark_catalog.default.bazaarlake_{hashlib.sha256(place.encode()).hexdigest()[:24]}"


def export_csv(df: DataFrame, folder: str) -> None:
    """A report as CSV files with headers; read by name they have its order."""
    df.write.mode("overwrite").option("header", True).csv(folder)
