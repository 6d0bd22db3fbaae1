"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlake.llm.common import WORD, Scratch, id_key, id_of, with_offsets

#: Words in a block of the schedule.
BLOCK = 512
#: A source is read this often at most.
MAX_EPOCHS = 3
#: Slots are made, and ranked, in pieces of this many.
PIECE = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Size, weight and target of every source; sizes has source and size.

    Sources in the order of their code points, NULL last, weigh 1, 2, 3, 1, ... and share all words by
    weight. None gets more than MAX_EPOCHS times what it has: with the sources sorted by what they have per
    unit of weight, those that are capped come first, and each is tested against the share that is left when
    all before it are capped. Windows run over one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighed = totals.withColumn(
        "weight",
        (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + F.lit(1).cast("long"),
    )
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    most = F.lit(MAX_EPOCHS) * F.col("source_size")
    tested = (
        weighed.withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_weights", F.sum("weight").over(everything))
        .withColumn("_spent", F.coalesce(F.sum(most).over(before), F.lit(0)))
        .withColumn("_gone", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn(
            "_capped",
            most * (F.col("_weights") - F.col("_gone")) <= (F.col("_all") - F.col("_spent")) * F.col("weight"),
        )
    )
    capped = lambda c: F.coalesce(F.sum(F.when(F.col("_capped"), c)).over(everything), F.lit(0))
    share = ((F.col("_all") - capped(most)) * F.col("weight")).cast("double") / (
        F.col("_weights") - capped(F.col("weight"))
    )
    return tested.select(
        "source", "source_size", "weight", F.when(F.col("_capped"), most.cast("double")).otherwise(share).alias("target")
    )


def quotas(targets: DataFrame, block: int) -> DataFrame:
    """Blocks of every source and the slots it needs: whole epochs, then blocks up to the target."""
    size, goal = F.col("source_size"), F.floor("target").cast("long")
    whole = F.floor(goal / size).cast("long")
    return (
        targets.where("source_size > 0")
        .withColumn("goal", goal)
        .withColumn("epochs", whole)
        .withColumn("rest", goal - whole * size)
        .withColumn("blocks", F.ceil(size / F.lit(block)).cast("long"))
        .withColumn("slots", F.col("epochs") * F.col("blocks") + F.ceil(F.col("rest") / F.lit(block)).cast("long"))
    )


def _point_at(slots: str) -> Column:
    """Of 2^_bits points the first that belongs to the slots after these, rounded up, in whole numbers."""
    points = f"cast({slots} AS decimal(19, 0)) * cast(shiftleft(1L, _bits) AS decimal(18, 0))"
    return F.expr(f"cast(({points} + _all - 1) div _all AS long)")


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """The order in which blocks are read: slot, source, epoch, block_index, tokens.

    The 2^k points of the van der Corput sequence are the numbers below 2^k with their bits reversed, so
    each source owns a run of points as long as its share of the slots, and its slots are the reversed
    points. Runs are made in pieces that are dealt out to all tasks, so no source's slots are made by one. Ranked by
    slot, the first ``slots`` of a source read its blocks in turn, again from the first after the last.
    Every prefix of the slots is close to the shares.
    """
    running = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    owned = (
        quotas(targets, block)
        .withColumn("_upto", F.sum("slots").over(running))
        .withColumn("_all", F.sum("slots").over(Window.partitionBy()))
        .where("slots > 0")
        .withColumn("_bits", F.length(F.bin(F.col("_all") - 1)))
        # A source's own run has ``slots`` points at least, as 2^k is not below their sum.
        .withColumn("_from", _point_at("_upto - slots"))
        .withColumn("_to", _point_at("_upto"))
    )
    points = (
        owned.withColumn("_piece", F.explode(F.expr(f"sequence(_from, greatest(_from, _to - 1), {PIECE}L)")))
        # A fixed number, as the pieces are few bytes but stand for PIECE rows each.
        .repartition(int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source", "_piece")
        .withColumn("_point", F.explode(F.expr(f"sequence(_piece, least(_to, _piece + {PIECE}L) - 1)")))
        .withColumn("slot", F.expr("cast(conv(reverse(lpad(bin(_point), _bits, '0')), 2, 10) as long)"))
        .withColumn("_time", F.expr(f"slot div {PIECE}"))
    )
    columns = ["source", "slot", "_time", "slots", "blocks", "epochs", "rest", "source_size"]
    ranked = with_offsets(points.select(*columns), ["source"], "_time", [F.col("slot")], {"slots": F.lit(1)})
    epoch = F.expr("slots_before div blocks")
    index = F.expr("slots_before % blocks")
    length = F.least(F.lit(block).cast("long"), F.col("source_size") - index * block)
    return (
        ranked.where(F.col("slots_before") < F.col("slots"))
        .withColumn("epoch", epoch)
        .withColumn("block_index", index)
        .withColumn("tokens", F.when(epoch < F.col("epochs"), length).otherwise(F.least(length, F.col("rest") - index * block)))
        .select("slot", "source", "epoch", "block_index", "tokens")
    )


def document_sizes(docs: DataFrame) -> DataFrame:
    """id, copy, source, size and how many rows are the same in all of these."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        docs.select(id_key().alias("id"), F.xxhash64(text).alias("copy"), "source", n_words(F.col("text")).alias("size"))
        .groupBy("id", "copy", "source", "size")
        .agg(F.count("*").alias("rows"))
    )


def mix(docs: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """How many words of each document the mix takes.

    A source's documents, in the order of a digest of their ids, are one stream of words, cut into blocks;
    blocks and schedule meet by source and block number. ``taken`` is a document's share of the blocks
    read: whole readings, then perhaps its first words once more.

    Returns a row per row: id, copy, source, size, source_size, target, taken. Sums per source are the
    targets without their fractions, and no document is above MAX_EPOCHS times its size. NULL text has no
    words; documents without words take none; NULL is a source of its own and NULL ids are one id. Rows that
    repeat share what is taken of them, rounded down. An empty table gives an empty result. Reruns give the
    same.
    """
    sizes = scratch.keep(document_sizes(docs), "sizes")
    targets = scratch.keep(source_targets(sizes.withColumn("size", F.col("size") * F.col("rows"))), "targets")
    words = F.col("size") * F.col("rows")
    digest = F.md5(F.col("id").cast("string"))
    streams = with_offsets(
        sizes.where("size > 0")
        .select("id", "copy", "source", words.alias("words"), digest.alias("_digest"))
        .withColumn("_bucket", F.substring("_digest", 1, 3)),
        ["source"],
        "_bucket",
        [F.col("_digest"), F.col("id"), F.col("copy")],
        {"words": F.col("words")},
    ).select("id", "copy", "source", "words", F.col("words_before").alias("start"))
    uses = (
        schedule(targets, block)
        .groupBy(F.col("source").alias("_source"), F.col("block_index").alias("_block"))
        .agg(F.collect_list("tokens").alias("reads"))  # one for each epoch at most
    )
    pieces = streams.withColumn(
        "at", F.explode(F.expr(f"sequence(start div {block}, (start + words - 1) div {block})"))
    ).select(
        "*",
        F.expr(f"greatest(0L, start - at * {block})").alias("lo"),
        F.expr(f"least({block}L, start + words - at * {block})").alias("hi"),
    )
    taken = (
        pieces.join(uses, F.col("source").eqNullSafe(F.col("_source")) & (F.col("at") == F.col("_block")))
        .select(
            F.col("id").alias("_id"),
            F.col("copy").alias("_copy"),
            F.col("source").alias("_from"),
            F.expr("aggregate(reads, 0L, (n, t) -> n + greatest(0L, least(t, hi) - lo))").alias("read"),
        )
        .groupBy("_id", "_copy", "_from")
        .agg(F.sum("read").alias("_taken"))
    )
    same = (F.col("id") == F.col("_id")) & (F.col("copy") == F.col("_copy")) & F.col("source").eqNullSafe(F.col("_from"))
    of_source = targets.select(F.col("source").alias("_source"), "source_size", "target")
    return (
        sizes.join(taken, same, "left")
        .join(of_source, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_row", F.explode(F.expr("sequence(1L, rows)")))
        .select(
            "id",
            "copy",
            "source",
            "size",
            "source_size",
            "target",
            F.expr("coalesce(_taken, 0L) div rows").alias("taken"),
        )
    )


def mixed_documents(docs: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """The documents as the mix reads them, with all their columns: one row for each reading.

    The last reading of one document of a source may end inside it; that row has the text up to the end of the
    last word that is read, white space as it is, and its own n_chars. Documents of which nothing is read, or without words, have no row.
    """
    decided = scratch.keep(
        mix(docs, scratch, block)
        .where("taken > 0")
        .select(
            F.col("id").alias("_id"), F.col("copy").alias("_copy"), F.col("source").alias("_source"), "size", "taken"
        )
        .distinct(),
        "decided",
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.struct(*docs.columns).alias("row"),
        id_key().alias("id"),
        F.xxhash64(text).alias("copy"),
        F.col("source").alias("from"),
    )
    same = (F.col("id") == F.col("_id")) & (F.col("copy") == F.col("_copy")) & F.col("from").eqNullSafe(F.col("_source"))
    read = (
        rows.join(decided.hint("merge"), same)
        .withColumn("reading", F.explode(F.expr("sequence(0L, (taken - 1) div size)")))
        .withColumn("words", F.expr("least(size, taken - reading * size)"))
    )
    # Each word with the white space before it: together they are the text up to its last word.
    worded = F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    some = F.array_join(F.slice(worded, F.lit(1), F.col("words").cast("int")), "")
    part = F.col("words") < F.col("size")
    columns = {c: F.col("row").getField(c) for c in docs.columns}
    columns["text"] = F.when(part, some).otherwise(columns["text"])
    if "n_chars" in columns:
        columns["n_chars"] = F.when(part, F.length(some).cast("long")).otherwise(columns["n_chars"])
    return read.select(*(c.cast(docs.schema[n].dataType).alias(n) for n, c in columns.items()))
