"""Session settings the jobs rely on."""

from __future__ import annotations

import math
import os
import re

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings only: they can be applied to a session somebody else
# started. Shuffle partitions, memory and the checkpoint folder stay the
# cluster's business; adaptive execution starts from more partitions where
# tables need them.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A split join is worth the extra shuffle when a later grouping would have
    # reused the join's partitioning.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# What one task gets at most, of a shuffle and of a file. A task that groups and joins lines per order
# sorts and hashes them several times and takes many times the bytes it reads (README).
TASK_BYTES = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 8 << 20,
    "spark.sql.files.maxPartitionBytes": 16 << 20,
}
# Rows of a table that a partition of its shuffles has on average at most.
TASK_ROWS = 200_000
PARTITIONS = "spark.sql.shuffle.partitions"
FIRST_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def _in_bytes(size: str) -> int:
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    for key, most in TASK_BYTES.items():
        if _in_bytes(spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))
    return spark


def shuffle_tasks(spark: SparkSession) -> int:
    """Partitions that a shuffle starts with; adaptive execution puts small ones together.

    Where it does, a first number that is set counts, even one below the session's number of partitions.
    """
    together = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.coalescePartitions.enabled")
    first = spark.conf.get(FIRST_PARTITIONS, None) if all(spark.conf.get(key) == "true" for key in together) else None
    return int(first or spark.conf.get(PARTITIONS))


def size_tasks(spark: SparkSession, rows: int) -> None:
    """Let shuffles start with as many partitions as a table's rows need, never with fewer than before."""
    needed = math.ceil(rows / TASK_ROWS)
    if needed > shuffle_tasks(spark):
        spark.conf.set(FIRST_PARTITIONS, str(needed))


def local_session(app: str = "bazaarlake", cpus: str | None = None) -> SparkSession:
    """A local session for tests and the bench, never for a cluster."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
