"""Building and refreshing the stored warehouse."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from bazaarlake.operators.skew import SkewProfile, measure
from bazaarlake.plans import audit, features, increment, quality
from bazaarlake.plans.warehouse import JOIN_COLUMNS, Warehouse
from bazaarlake.session import shuffle_tasks, size_tasks
from bazaarlake.sources import files, records
from bazaarlake.sources.schemas import DATASETS
from bazaarlake.sources.storage import Buckets, Stored, TableStore, export_csv

# Stored tables with the datasets each depends on, in waves: the tables of a
# wave need only those of earlier waves.
WAVES = [
    {
        "stg_customers": {"customers"},
        "stg_orders": {"orders"},
        "stg_order_items": {"order_items"},
        "stg_payments": {"order_payments"},
        "stg_reviews": {"order_reviews"},
        "stg_products": {"products", "category_translation"},
        "stg_sellers": {"sellers"},
        "stg_geolocation": {"geolocation"},
    },
    {
        "dim_customers": {"customers", "geolocation"},
        "dim_sellers": {"sellers", "geolocation"},
        "dim_products": {"products", "category_translation"},
        "dim_dates": {"orders"},
        "fct_payments": {"order_payments"},
        "order_heads": {"orders", "customers"},
    },
    {"order_lines": {"order_items", "orders", "customers"}},
]
TABLES = {name: needs for wave in WAVES for name, needs in wave.items()}
# Writes submitted together; small tables fill the gaps of large ones.
CONCURRENT_WRITES = 4
PARTITIONED = {"order_heads": "purchase_month", "order_lines": "purchase_month"}
# Keys of point lookups: files are sorted by them and have bloom filters for them.
LOOKUP = {
    "order_heads": "order_id",
    "order_lines": "order_id",
    "dim_products": "product_id",
    "seller_scores": "seller_id",
    "delivery_lanes": "origin_zip",
}

# Tables in buckets of a key, of which all have the same number: grouping their rows by the key and joining
# them by it moves nothing. A key that outgrows half a task would fill a bucket, so such a table is stored
# without buckets, and grouped where it is read instead.
BUCKETED = {"order_lines": "order_id", "stg_reviews": "order_id", "fct_payments": "order_id"}
MOST_BUCKETS = 100_000  # of Spark

# Manifest entry that holds the skew profile of the version.
SKEW = "_skew"
# Manifest entry that holds the number of lines of the version.
LINES = "_lines"
NOTES = {SKEW, LINES, increment.BATCHES}

FIRST_LOAD = "first load"

_SALES = {"order_items", "orders", "customers"}
REPORTS: dict[str, tuple[Callable[[Warehouse], DataFrame], set[str]]] = {
    "seller_scores": (features.seller_scores, _SALES | {"order_reviews", "sellers"}),
    "customer_rfm": (features.customer_rfm, _SALES),
    "cohort_retention": (features.cohort_retention, {"orders", "customers"}),
    "delivery_lanes": (features.delivery_lanes, _SALES | {"sellers", "geolocation"}),
}
# Reports that are also written as CSV, with the order of their rows.
CSV_REPORTS = {"seller_scores": "performance_score", "cohort_retention": None}


def stored_tables(store: TableStore, tables: Mapping[str, Stored]) -> dict[str, Callable]:
    return {
        name: (lambda table=table: store.open(table))
        for name, table in tables.items()
        if name in TABLES
    }


def open_warehouse(store: TableStore, version: int | None = None) -> Warehouse:
    """The stored warehouse of a version, by default the current one.

    Tables and reports are those of the version, with the skew measured and the
    lines counted when it was built; raw records are those in the store now.
    """
    tables = store.tables(version)
    stored = {name: (lambda table=table: store.open(table)) for name, table in tables.items() if name not in NOTES}
    skew = SkewProfile.from_json(tables[SKEW].path) if SKEW in tables else None
    wh = Warehouse(raw=store.all_raw(), stored=stored, skew=skew)
    if LINES in tables:
        wh.counted["stg_order_items"] = store.spark, int(tables[LINES].path)
        wh.fit_session()
    return wh


def load(
    store: TableStore, folder: str, file_names: Mapping[str, str] = files.FILES
) -> DataFrame:
    """First load of the nine CSV datasets; returns the rows per dataset."""
    raw = files.scan_folder(store.spark, folder, file_names)
    batch = store.batch_of(FIRST_LOAD)
    for dataset, rows in raw.items():
        store.write_raw(dataset, rows, batch)
    return records.raw_row_counts(store.all_raw())


def _write_all(
    store: TableStore,
    tables: dict[str, DataFrame],
    version: int,
    buckets: Mapping[str, Buckets] | None = None,
) -> dict[str, Stored]:
    """Write independent tables side by side; the first failure is raised."""
    buckets = buckets or {}
    with ThreadPoolExecutor(CONCURRENT_WRITES) as pool:
        writes = {
            name: pool.submit(
                store.write_table, name, df, version, PARTITIONED.get(name), LOOKUP.get(name), buckets.get(name)
            )
            for name, df in tables.items()
        }
        return {name: write.result() for name, write in writes.items()}


def _bucketed(wh: Warehouse, names: Iterable[str], number: int) -> dict[str, Buckets]:
    """Buckets of those of the tables in which no key outgrows a bucket."""
    out = {}
    for name in sorted(BUCKETED.keys() & set(names)):
        key = BUCKETED[name]
        # Lines have the keys of the items, which are measured anyway.
        hot = wh.hot(key) if name == "order_lines" else measure(wh.table(name).select(key), [key])[key]
        if not hot:
            out[name] = Buckets(key, number, PARTITIONED.get(name))
    return out


def refresh(
    store: TableStore,
    touched: Iterable[str] = DATASETS,
    export_to: str | None = None,
    whole: bool = False,
) -> int:
    """Bring what depends on the touched datasets up to date from the stored raw batches; returns the new version.

    Where a dataset only gained batches, rows are added and the purchase months reached are written again
    (``increment``); ``whole`` writes every dependent table anew.
    """
    return publish(store, store.all_raw(), touched, export_to, store.batches(), whole)


def publish(
    store: TableStore,
    raw: Mapping[str, DataFrame],
    touched: Iterable[str] = DATASETS,
    export_to: str | None = None,
    batches: Mapping[str, Mapping[int, str]] | None = None,
    whole: bool = False,
) -> int:
    """Bring what depends on the touched datasets up to date and switch to it.

    ``batches`` are the raw batches in the store if ``raw`` is made of them; without them every dependent
    table is written anew. Every table is written before the next one reads it, so no plan spans the
    whole build and a lost executor costs one table's work at most. Checks run
    between tables and reports; if one fails, the old version stays current.
    """
    touched = set(touched)
    before = store.version()
    version = 0 if before is None else before + 1
    current = store.tables(before)
    tables = dict(current)
    news = {} if whole or batches is None else increment.arrived(current, batches, touched)
    new = increment.Increment(store, current, news, version)

    def stale(name: str, needs: set[str]) -> bool:
        return bool(needs & touched) or name not in current

    fresh = {n: t for n, t in current.items() if n in TABLES and not stale(n, TABLES[n])}
    # The profile is measured with every whole build; additions are small against what it was measured on.
    skew = SkewProfile.from_json(current[SKEW].path) if SKEW in current and touched <= news.keys() else None
    wh = Warehouse(raw=raw, stored=stored_tables(store, fresh), skew=skew)
    tables.pop(SKEW, None)
    # No table has more rows than the lines.
    lines = raw["order_items"].count()
    size_tasks(store.spark, lines)
    # Tables that stay or are added to have their number of buckets, so new ones get the same.
    staying = [
        current[name].buckets
        for name in BUCKETED
        if name in current and (not stale(name, TABLES[name]) or new.reaches(name, TABLES[name], touched))
    ]
    number = next((buckets.number for buckets in staying if buckets), None)
    number = number or min(shuffle_tasks(store.spark), MOST_BUCKETS)
    for wave in WAVES:
        due = {name for name, needs in wave.items() if stale(name, needs)}
        added = {name for name in due if new.reaches(name, TABLES[name], touched)}
        anew = {name: wh.table(name) for name in wave if name in due - added}
        written = _write_all(store, anew, version, _bucketed(wh, anew, number))
        with ThreadPoolExecutor(CONCURRENT_WRITES) as pool:
            updates = {name: pool.submit(new.update, name, wh, LOOKUP.get(name)) for name in added}
            written |= {name: update.result() for name, update in updates.items()}
        tables |= written
        for name, read in stored_tables(store, written).items():
            wh.keep(name, read)
    quality.enforce(quality.report(wh))
    due = {name: report(wh) for name, (report, needs) in REPORTS.items() if stale(name, needs)}
    tables |= _write_all(store, due, version)
    for columns in JOIN_COLUMNS.values():
        wh.hot(columns[0])
    tables[SKEW] = Stored(wh.skew.to_json(), "")
    tables[LINES] = Stored(str(lines), "")
    known = {} if batches is None else {d: batches[d] for d in touched}
    # A table that was missing has been made of all batches, so what the others hold is unknown then.
    kept = increment.held(current) if TABLES.keys() <= current.keys() else {}
    tables[increment.BATCHES] = Stored(increment.to_json(kept | known), "")
    store.commit(tables, version)
    if export_to:
        for name, order in CSV_REPORTS.items():
            report = store.open(tables[name])
            keys = [order] if order else report.columns[:2]
            export_csv(report.orderBy(*keys), f"{export_to}/{name}")
    return version


def run(
    spark: SparkSession,
    source: str,
    target: str,
    confirm: bool = True,
    file_names: Mapping[str, str] = files.FILES,
    export_to: str | None = None,
) -> TableStore | None:
    """Load, transform, check, report; the first failure ends the run.

    Without ``confirm`` nothing is written: only the presence of the source
    files is checked.
    """
    if not confirm:
        files.scan_folder(spark, source, file_names)
        return None
    store = TableStore(spark, target)
    load(store, source, file_names)
    refresh(store, export_to=export_to)
    return store


def append(
    store: TableStore,
    dataset: str,
    rows: DataFrame,
    confirm: bool = False,
    delivery: str | None = None,
) -> DataFrame:
    """Validated rows of one dataset; stored as a new batch if confirmed.

    Rows handed in again under the same ``delivery`` name replace their batch.
    A refresh of the dataset brings them into the tables. Rows that would fail
    its checks are refused with ``audit.RefusedBatch``, which names them, and
    change nothing.
    """
    valid = records.validate(dataset, rows)
    if confirm:
        name = delivery or str(uuid.uuid4())
        audit.admit(store, dataset, valid, store.batch_of(f"append {dataset} {name}"))
    return valid


class LiveReports:
    """Reports held in memory for lookups, dropped when a new version appears."""

    def __init__(self, store: TableStore):
        self.store = store
        self._version: int | None = None
        self._held: dict[str, DataFrame] = {}

    def reload(self) -> None:
        for report in self._held.values():
            report.unpersist()
        self._held.clear()
        self._version = self.store.version()

    def get(self, report: str) -> DataFrame:
        if self.store.version() != self._version:
            self.reload()
        if report not in self._held:
            self._held[report] = self.store.read(report, self._version).persist()
        return self._held[report]
