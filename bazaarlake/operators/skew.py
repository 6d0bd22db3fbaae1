"""Joins that survive a key holding a large share of the rows.

A profile of the few keys that dominate a column is measured once per table:
rows are counted by ranges of the key's hash, and keys only inside ranges that
hold more than half a task, which without a hot key are none. Counts are exact
and stay on the executors, whatever the number of tasks. What counts as hot
follows the size of a task: a key with more rows than half a task has on
average is salted, with as many salts as it fills half tasks. The profile only decides which rows are
salted: the result of a join is the same whatever it contains.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlake.session import shuffle_tasks

# Hash ranges for each half task: an even range has an eighth of one.
RANGES = 8
# Row number given at the scan: spreads even exact copies of a row.
ROW = "_row"


@dataclass(frozen=True)
class HotKeys:
    """Hot keys with the number of tasks that each is spread over."""

    salts: dict = field(default_factory=dict)

    def __bool__(self) -> bool:
        return bool(self.salts)


@dataclass(frozen=True)
class SkewProfile:
    """Hot keys by measured column; a column not measured counts as even."""

    measured: dict[str, HotKeys] = field(default_factory=dict)

    def __getitem__(self, column: str) -> HotKeys:
        return self.measured.get(column, HotKeys())

    def merge(self, other: "SkewProfile") -> "SkewProfile":
        return SkewProfile({**self.measured, **other.measured})

    def to_json(self) -> str:
        return json.dumps({name: list(hot.salts.items()) for name, hot in self.measured.items()})

    @classmethod
    def from_json(cls, text: str) -> "SkewProfile":
        return cls({name: HotKeys(dict(map(tuple, pairs))) for name, pairs in json.loads(text).items()})


def _range(column: Column, ranges: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(ranges))


def measure(df: DataFrame, columns: list[str], tasks: int | None = None) -> SkewProfile:
    """Find hot keys of several columns: one pass, and one more over each column with heavy ranges.

    ``tasks`` is the number of shuffle partitions by default. Ranges and keys are counted with partial
    sums; only those above half a task come back, at most two per column and task.
    """
    halves = 2 * (tasks or shuffle_tasks(df.sparkSession))
    ranges = [_range(F.col(name), RANGES * halves) for name in columns]
    counted = (
        df.select(F.posexplode(F.array(*ranges)).alias("_column", "_range"))
        .groupBy("_column", "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    # Every row is counted once per column; one row, from the same shuffle.
    rows = counted.agg((F.sum("_n") / len(columns)).alias("_rows"))
    above = F.col("_n") > F.greatest(F.col("_rows") / halves, F.lit(1.0))
    heavy = counted.crossJoin(F.broadcast(rows)).filter(above).collect()
    half = heavy[0]["_rows"] / halves if heavy else 0.0
    measured = {name: HotKeys() for name in columns}
    for at, name in enumerate(columns):
        own = [(row["_range"],) for row in heavy if row["_column"] == at]
        if own:
            table = F.broadcast(df.sparkSession.createDataFrame(own, "_range long"))
            found = (
                df.select(F.col(name).alias("_key"), ranges[at].alias("_range"))
                .join(table, "_range", "left_semi")
                .groupBy("_key")
                .agg(F.count(F.lit(1)).alias("_n"))
                .filter(F.col("_n") > max(half, 1.0))
                .collect()
            )
            measured[name] = HotKeys({row["_key"]: math.ceil(row["_n"] / half) for row in found})
    return SkewProfile(measured)


def skew_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    hot: HotKeys,
    how: str = "left",
    order_sized: bool = False,
) -> DataFrame:
    """Join ``left`` (the big side) to a lookup, salting the hot keys of ``left``.

    Rows of a hot key are spread over its salts, by their number from the scan
    (``ROW``) if they have one, else by a hash of the row; only the lookup rows
    of hot keys are copied, no more in all than there are half tasks. The table
    of hot keys is broadcast: it has two rows per shuffle partition at most.

    ``order_sized`` says that the lookup grows with the orders. It is then
    merge-joined at any size: broadcasting it could only work on small data,
    and the grouping per order that follows reuses the shuffle.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"cannot salt a {how} join")
    if not hot:
        return left.join(right.hint("merge") if order_sized else right, key, how)
    kind = left.schema[key].dataType.simpleString()
    table = F.broadcast(
        left.sparkSession.createDataFrame(list(hot.salts.items()), f"_hot {kind}, _salts int")
    )
    number = F.col(ROW) if ROW in left.columns else F.xxhash64(*left.columns)
    salted = (
        left.join(table, F.col(key).eqNullSafe(F.col("_hot")), "left")
        .withColumn("_salt", F.coalesce(F.pmod(number, F.col("_salts")).cast("int"), F.lit(0)))
        .drop("_hot", "_salts")
    )
    lookup = (
        right.join(table, F.col(key) == F.col("_hot"), "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .drop("_hot", "_salts")
    )
    lookup = lookup.hint("merge") if order_sized else lookup
    return salted.join(lookup, [key, "_salt"], how).drop("_salt")


def scan_order() -> Column:
    """Row numbers for rows fresh from a scan; the same on every attempt."""
    return F.monotonically_increasing_id()
