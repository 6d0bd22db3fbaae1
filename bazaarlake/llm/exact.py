"""Exact deduplication by distributed most-significant-digit radix partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlake.llm.common import Scratch

#: Bytes of the first digit, and by how much each next digit is wider.
WIDTH, GROWTH = 64, 8


def radix_groups(
    docs: DataFrame,
    scratch: Scratch,
    id_column: str = "doc_id",
    text_column: str = "text",
    carry: tuple[str, ...] = (),
    with_text: bool = False,
    width: int = WIDTH,
    growth: int = GROWTH,
) -> DataFrame:
    """Groups of rows whose texts are equal byte for byte; of each the row with the largest id stays.

    Level by level the rows of a group part by their next bytes, the digit. A group of one row is done; a
    digit shorter than its width means that the texts have ended, and what is still together is equal.
    Only the rest goes on to the next, wider digit, so unlike texts cost one digit and the number of levels
    grows with the logarithm of the longest text. A group's name is the number of its first row: nothing
    is decided by a digest.

    A level counts its groups with partial sums and keeps those of two rows or more; rows meet them in a
    left join whose large partitions may be split, so a group of a third of all rows is no hot task. It is a
    merge join at every size: the groups grow with the corpus and are never broadcast.

    Returns a row per input row: doc_id, keep_id, group_size, kept, the ``carry`` columns in the struct
    ``row`` (so that none of their names can clash) and, if asked for, the text. NULL text is empty. NULL ids are below all others. Of repeated rows
    with the largest id exactly one stays. An empty table gives an empty result.
    """
    body = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(id_column).alias("_id"),
        F.struct(F.lit(0).alias("_none"), *carry).alias("_carry"),
        body.alias("_body"),
        F.lit(0).cast("long").alias("_group"),
    )
    done: list[DataFrame] = []
    at, level = 1, 0
    while True:
        keyed = rows.withColumn("_digit", F.substring("_body", at, width))
        groups = scratch.keep(
            keyed.groupBy("_group", "_digit")
            .agg(
                F.min("_row").alias("_next"),
                F.max(F.struct("_id", "_row")).alias("_top"),
                F.count("*").alias("_size"),
            )
            .where("_size > 1"),
            f"groups{level}",
        )
        open_ = F.col("_size").isNotNull() & (F.length("_digit") == width)
        parted = (
            keyed.join(groups.hint("merge"), ["_group", "_digit"], "left")
            .withColumn("_open", open_)
            .select(
                "_row",
                "_id",
                "_carry",
                F.when(F.col("_open") | F.lit(with_text), F.col("_body")).alias("_body"),
                F.when(F.col("_open"), F.col("_next")).alias("_group"),
                F.coalesce("_top", F.struct("_id", "_row")).alias("_top"),
                F.coalesce("_size", F.lit(1).cast("long")).alias("_size"),
                "_open",
            )
        )
        parted = scratch.keep(parted, f"rows{level}")
        done.append(parted.where(~F.col("_open")))
        rows = parted.where("_open").select("_row", "_id", "_carry", "_body", "_group")
        if rows.isEmpty():
            break
        at, width, level = at + width, width * growth, level + 1

    everything = done[0]
    for more in done[1:]:
        everything = everything.unionByName(more)
    return everything.select(
        F.col("_id").alias("doc_id"),
        F.col("_top._id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_row") == F.col("_top._row")).alias("kept"),
        F.col("_carry").alias("row"),
        *([F.col("_body").cast("string").alias("text")] if with_text else []),
    )


def exact_dedup(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents that stay, with the columns they came with; NULL text stays NULL if it stays."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select(
        "doc_id", "text", F.struct(F.col("text").isNull().alias("no_text"), *others).alias("others")
    )
    kept = radix_groups(rows, scratch, carry=("others",), with_text=True).where("kept")
    columns = {
        "doc_id": F.col("doc_id"),
        "text": F.when(~F.col("row.others.no_text"), F.col("text")),
        **{c: F.col("row.others").getField(c) for c in others},
    }
    return kept.select(*(columns[c].alias(c) for c in docs.columns))
