"""A trie of conversations: z-fast, with handles in a table, filled in batches and expanded into its nodes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlake.llm.common import NO_ID, Scratch, batches, id_key, id_of

#: Prefixes are named by a polynomial over their turns' digests, modulo a prime: what is hashed in parts can be
#: put together, and prefix hashes of one part give those of a sequence that contains it.
PRIME, BASE = 2**127 - 1, 0x3A5C_9D27_6E81_40B7_F1D3_8C26_59EA_7B41
#: The empty prefix.
ROOT = bytes(16)
#: Conversations of every sixteen that are in the trie after each batch.
BATCHES = (1, 4, 16)
#: Depths of an edge that one row stands for before they become rows; ids in one text before it is digested.
STEP, IDS = 10_000, 10_000


def _number(code: bytes | None) -> int:
    return int.from_bytes(code or ROOT)


def _code(number: int) -> bytes:
    return number.to_bytes(16)


def _after(head: int, tail: int, n: int) -> int:
    """The hash of a sequence from its head's and that of its last n turns."""
    return (head * pow(BASE, n, PRIME) + tail) % PRIME


# -- prefix hashes ----------------------------------------------------------------------------------------

PART = pa.schema(
    [("part", pa.int64()), ("conv", pa.int64()), ("at", pa.int64())]
    + [("prev", pa.binary()), ("hash", pa.binary()), ("size", pa.int64()), ("bytes", pa.int64())]
)
PART_DDL = "part long, conv long, at long, prev binary, hash binary, size long, bytes long"


def _hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns with the prefix hashes and bytes of their conversation as far as it lies in this partition."""

    def rows():
        part, last, at, hash_, total = TaskContext.get().partitionId(), None, 0, 0, 0
        for batch in parts:
            for conv, digest, size in zip(*(batch.column(c).to_pylist() for c in ("conv", "digest", "size"))):
                if conv != last:
                    last, at, hash_, total = conv, 0, 0, 0
                before = _code(hash_)
                hash_ = (hash_ * BASE + int.from_bytes(digest) % (PRIME - 1) + 1) % PRIME
                at, total = at + 1, total + size
                yield part, conv, at, before, _code(hash_), size, total

    return batches(rows(), PART)


CARRY_DDL = "part long, conv long, at0 long, hash0 binary, bytes0 long"
CARRY = pa.schema(
    [("part", pa.int64()), ("conv", pa.int64()), ("at0", pa.int64()), ("hash0", pa.binary()), ("bytes0", pa.int64())]
)


def _carried(rows: pa.Table) -> pa.Table:
    """What lies before each part of one conversation; a conversation has one row per partition it touches."""
    out, at, hash_, total = [], 0, 0, 0
    for r in sorted(rows.to_pylist(), key=lambda r: r["part"]):
        out.append((r["part"], r["conv"], at, _code(hash_), total))
        hash_ = _after(hash_, _number(r["top"]["hash"]), r["top"]["at"])
        at, total = at + r["top"]["at"], total + r["top"]["bytes"]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), CARRY)], schema=CARRY)


TURN = pa.schema([f for f in PART if f.name != "part"])
TURN_DDL = "conv long, at long, prev binary, hash binary, size long, bytes long"


def _joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in parts:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                conv, at, prev, hash_, size, total, at0, hash0, bytes0 = r
                if at0:
                    head = _number(hash0)
                    prev = _code(_after(head, _number(prev), at - 1))
                    hash_ = _code(_after(head, _number(hash_), at))
                    at, total = at + at0, total + bytes0
                yield conv, at, prev, hash_, size, total

    return batches(rows(), TURN)


def turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv, at (from 1), hash of the first ``at`` turns and of those before, bytes of the text and up to here.

    Turns are range-partitioned by conversation and place, so one conversation may fill many tasks; what lies
    before a partition is put together from one row per partition and conversation.
    """
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.sha2(role, 256), F.sha2(text, 256)), 256))
    order = [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    local = scratch.keep(
        conversations.select(
            id_key("conv_id").alias("conv"),
            "turn",
            role.alias("role"),
            digest.alias("digest"),
            F.octet_length(text).cast("long").alias("size"),
        )
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(_hashed, PART_DDL),
        "local",
    )
    tops = scratch.keep(
        local.groupBy("part", "conv").agg(F.max(F.struct("at", "hash", "bytes")).alias("top")), "tops"
    )
    split = tops.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select("conv")
    carry = scratch.keep(tops.join(split, "conv", "left_semi").groupBy("conv").applyInArrow(_carried, CARRY_DDL), "carry")
    return scratch.keep(
        local.join(carry, ["part", "conv"], "left")
        .select("conv", "at", "prev", "hash", "size", "bytes", "at0", "hash0", "bytes0")
        .mapInArrow(_joined, TURN_DDL),
        "turns",
    )


PATH_DDL = "conv long, depth long, prev binary, hash binary, size long, bytes long, ends boolean"
PATH = pa.schema(
    [("conv", pa.int64()), ("depth", pa.int64()), ("prev", pa.binary()), ("hash", pa.binary())]
    + [("size", pa.int64()), ("bytes", pa.int64()), ("ends", pa.bool_())]
)


def _moved(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Own turns after the first ``skip``, behind ``lead`` turns of another conversation."""

    def rows():
        for batch in parts:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                conv, at, prev, hash_, size, total, n, skip, cut, cut_bytes, lead, head, head_bytes = r
                own, front = _number(cut), _number(head)

                def code(hash_: bytes, i: int) -> bytes:
                    return _code(_after(front, _number(hash_) - _after(own, 0, i), i))

                i = at - skip
                yield conv, lead + i, code(prev, i - 1), code(hash_, i), size, head_bytes + total - cut_bytes, at == n

    return batches(rows(), PATH)


def paths(conversations: DataFrame, scratch: Scratch, base: Column | None = None, history: Column | None = None) -> DataFrame:
    """conv, depth, prev, hash, size, bytes, ends: the prefixes of every conversation, without the empty one.

    Each conversation is its first ``history`` turns taken from the conversation ``base`` (none if there is
    none), then its own turns after as many; both are expressions of ``conv`` (``history`` 8 at most). One
    without turns has a row at depth 0. NULL conv_ids are one conversation without a history of its own.
    """
    known = F.col("conv") != NO_ID
    skip = F.coalesce(F.when(known, history), F.lit(0)) if history is not None else F.lit(0)
    own = turns(conversations, scratch)
    at_head = F.when(F.col("at") <= 8, F.struct("at", "prev", "hash", "size", "bytes"))  # collect_list leaves NULLs out
    heads = scratch.keep(
        own.groupBy("conv").agg(F.max("at").alias("n"), F.sort_array(F.collect_list(at_head)).alias("heads")), "heads"
    )
    others = heads.select(F.col("conv").alias("base"), F.col("heads").alias("lent"))
    plan = (
        heads.withColumn("skip", skip.cast("int"))
        .withColumn("base", F.coalesce(F.when(known, base), F.col("conv")) if base is not None else F.col("conv"))
        .join(others, "base", "left")
        .withColumn("lent", F.slice(F.coalesce("lent", F.array()), 1, F.col("skip")))
        .withColumn("lead", F.size("lent").cast("long"))
        .withColumn("top", F.when(F.col("lead") > 0, F.element_at("lent", -1)))
        .withColumn("cut", F.when((F.col("skip") > 0) & (F.col("n") > F.col("skip")), F.get("heads", F.col("skip") - 1)))
    )
    zero = F.lit(0).cast("long")
    plan = scratch.keep(
        plan.select(
            "conv",
            "n",
            F.col("skip").cast("long").alias("skip"),
            "lent",
            "lead",
            F.col("top.hash").alias("head"),
            F.coalesce("top.bytes", zero).alias("head_bytes"),
            F.col("cut.hash").alias("cut"),
            F.coalesce("cut.bytes", zero).alias("cut_bytes"),
        ),
        "plan",
    )
    lent = plan.select("conv", "n", "skip", "lead", F.explode("lent").alias("t")).select(
        "conv",
        F.col("t.at").alias("depth"),
        "t.prev",
        "t.hash",
        "t.size",
        "t.bytes",
        ((F.col("n") <= F.col("skip")) & (F.col("t.at") == F.col("lead"))).alias("ends"),
    )
    bare = plan.where("lead = 0 AND n <= skip").select(
        "conv", zero.alias("depth"), F.lit(ROOT).alias("prev"), F.lit(ROOT).alias("hash"),
        zero.alias("size"), zero.alias("bytes"), F.lit(True).alias("ends"),
    )
    after = (
        own.join(plan.drop("lent"), "conv")
        .where("at > skip")
        .select(
            *("conv", "at", "prev", "hash", "size", "bytes", "n", "skip", "cut", "cut_bytes", "lead", "head", "head_bytes")
        )
        .mapInArrow(_moved, PATH_DDL)
    )
    return scratch.keep(lent.unionByName(after).unionByName(bare), "paths")


# -- the trie ---------------------------------------------------------------------------------------------

#: key and len: hash and depth of the extent. up: depth of the parent's extent, parent: its hash. rep: a
#: conversation that begins with the extent. first: hash one turn below the parent. fat: hash at the handle.
#: before, total: bytes of the texts down to the parent and down to here.
NODE_DDL = "key binary, len long, up long, parent binary, rep long, first binary, fat binary, before long, total long"


def two_fattest(lo: str, hi: str) -> Column:
    """The number in (lo, hi] that the largest power of two divides."""
    bits = f"length(bin({lo} ^ {hi})) - 1"
    return F.expr(f"shiftleft(shiftright({hi}, {bits}), {bits})")


def _at(paths_: DataFrame, conv: str, depth: str, **columns: str) -> DataFrame:
    """The given columns of prefixes, under their new names, to be joined by conversation and depth."""
    return paths_.select(
        F.col("conv").alias(conv), F.col("depth").alias(depth), *(F.col(c).alias(n) for n, c in columns.items())
    )


def _located(queries: DataFrame, paths_: DataFrame, nodes: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """conv, n, top (depth of the deepest node that the conversation goes through) and exit (key of the edge
    below it on which the conversation leaves or ends; NULL if it takes none).

    Fat binary search: the handle table is asked for the prefix at the two-fattest depth of what is open.
    A hit goes on below that node's extent, a miss above the depth, so rounds grow with the logarithm of
    the longest conversation. What is found is the exit node or its parent; one look at the extent tells.
    """
    handles = nodes.select(
        F.col("fat").alias("probe"), F.col("key").alias("k"), F.col("len").alias("l"), F.col("up").alias("u")
    )
    zero = F.lit(0).cast("long")
    state = queries.select(
        "conv", "n", zero.alias("lo"), F.col("n").alias("hi"), F.lit(ROOT).alias("key"), zero.alias("len"), zero.alias("up")
    )
    closed, round_ = [], 0
    while True:
        state = scratch.keep(state, f"{name}_search{round_}")
        closed.append(state.where("lo >= hi"))
        open_ = state.where("lo < hi")
        if open_.isEmpty():
            break
        hit = F.col("k").isNotNull()
        state = (
            open_.withColumn("f", two_fattest("lo", "hi"))
            .join(_at(paths_, "conv", "f", probe="hash"), ["conv", "f"])
            .join(handles, "probe", "left")
            .select(
                "conv",
                "n",
                F.when(hit, F.col("l")).otherwise(F.col("lo")).alias("lo"),
                F.when(hit, F.col("hi")).otherwise(F.col("f") - 1).alias("hi"),
                F.coalesce("k", "key").alias("key"),
                F.coalesce("l", "len").alias("len"),
                F.coalesce("u", "up").alias("up"),
            )
        )
        round_ += 1
    found = closed[0]
    for more in closed[1:]:
        found = found.unionByName(more)
    through = (F.col("len") == 0) | (F.coalesce(F.col("own") == F.col("key"), F.lit(False)))
    edges = nodes.select(F.col("first").alias("next"), F.col("key").alias("child"))
    return scratch.keep(
        found.join(_at(paths_, "conv", "len", own="hash"), ["conv", "len"], "left")
        .select("conv", "n", through.alias("through"), "key", F.when(through, F.col("len")).otherwise(F.col("up")).alias("top"))
        .withColumn("below", F.col("top") + 1)
        .join(_at(paths_, "conv", "below", next="hash"), ["conv", "below"], "left")
        .join(edges, "next", "left")
        .select("conv", "n", "top", F.when(F.col("through"), F.col("child")).otherwise(F.col("key")).alias("exit")),
        f"{name}_located",
    )


def _depths(df: DataFrame, lowest: Column, highest: Column) -> DataFrame:
    """A row for each depth, made STEP at a time."""
    starts = F.when(highest >= lowest, F.sequence(lowest, highest, F.lit(STEP).cast("long")))
    last = F.least(F.col("_from") + STEP - 1, highest)
    return (
        df.withColumn("_from", F.explode(starts))
        .withColumn("depth", F.explode(F.sequence(F.col("_from"), last)))
        .drop("_from")
    )


def _inserted(located: DataFrame, paths_: DataFrame, nodes: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The nodes after a batch: only edges on which one of its conversations leaves are opened.

    What the batch adds below the nodes it goes through and the prefixes on the opened edges are grouped by
    hash. A prefix is a node if a conversation ends there, if it was one, or if it goes on in two ways.
    """
    touched = nodes.join(located.select(F.col("exit").alias("key")).distinct(), "key", "left_semi")
    opened = (
        _depths(touched.select("rep", "up", "len", F.col("key").alias("edge")), F.col("up") + 1, F.col("len"))
        .join(_at(paths_, "rep", "depth", prev="prev", hash="hash"), ["rep", "depth"])
        .select(F.col("rep").alias("conv"), "edge", "depth", "prev", "hash", F.col("up").alias("top"), (F.col("depth") == F.col("len")).alias("stays"))
    )
    added = (
        paths_.where("depth > 0")
        .join(located.select("conv", "top"), "conv")
        .where("depth > top")
        .select("conv", F.lit(None).cast("binary").alias("edge"), "depth", "prev", "hash", "top", F.col("ends").alias("stays"))
    )
    region = scratch.keep(opened.unionByName(added), f"{name}_region")
    prefixes = region.groupBy("hash").agg(F.first("prev").alias("prev"), F.max("stays").alias("stays"))
    forks = prefixes.groupBy(F.col("prev").alias("hash")).agg(F.count("*").alias("ways"))
    compact = prefixes.join(forks, "hash", "left").where("stays OR ways > 1").select("hash")
    line = Window.partitionBy("conv", "edge").orderBy("depth")
    fresh = scratch.keep(
        region.join(compact, "hash", "left_semi")
        .select("hash", "depth", "conv", F.lag("depth").over(line).alias("_up"), "top")
        .groupBy("hash")
        .agg(
            F.min(F.struct("conv", "depth", F.coalesce("_up", "top").alias("up"))).alias("r")  # all agree on depth and up
        )
        .select(F.col("hash").alias("key"), F.col("r.depth").alias("len"), "r.up", F.col("r.conv").alias("rep"))
        .withColumn("f", two_fattest("up", "len"))
        .withColumn("below", F.col("up") + 1),
        f"{name}_fresh",
    )
    made = (
        fresh.join(_at(paths_, "rep", "f", fat="hash"), ["rep", "f"])
        .join(_at(paths_, "rep", "len", total="bytes"), ["rep", "len"])
        .join(_at(paths_, "rep", "below", parent="prev", first="hash", _b="bytes", _s="size"), ["rep", "below"])
        .withColumn("before", F.col("_b") - F.col("_s"))
    )
    columns = [c.split()[0] for c in NODE_DDL.split(", ")]
    return scratch.keep(
        nodes.join(touched.select("key"), "key", "left_anti").select(columns).unionByName(made.select(columns)),
        f"{name}_nodes",
    )


def compacted(paths_: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes of the z-fast trie over all conversations but its root; see NODE_DDL."""
    every = scratch.keep(paths_.where("ends").select("conv", F.col("depth").alias("n")), "lengths")
    share = F.pmod(F.xxhash64("conv"), F.lit(16))
    nodes = scratch.keep(paths_.sparkSession.createDataFrame([], NODE_DDL), "no_nodes")
    for i, (lo, hi) in enumerate(zip((0, *BATCHES), BATCHES)):
        located = _located(every.where((share >= lo) & (share < hi)), paths_, nodes, scratch, f"batch{i}")
        nodes = _inserted(located, paths_, nodes, scratch, f"batch{i}")
    return nodes


def _summed(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes with the sums of n, leaves, weighed and alone, and the least conv, of their whole subtrees.

    Each round adds what the nodes twice as far below have summed, so rounds grow with the logarithm of the
    height and no node is joined with all its ancestors.
    """
    sums, round_ = ["n", "leaves", "weighed", "alone"], 0
    state = scratch.keep(nodes.withColumn("above", F.col("parent")), "sums0")
    while not state.where("above IS NOT NULL").isEmpty():
        round_ += 1
        given = (
            state.where("above IS NOT NULL")
            .groupBy(F.col("above").alias("key"))
            .agg(*(F.sum(c).alias(f"_{c}") for c in sums), F.min("least").alias("_least"))
        )
        farther = state.select(F.col("key").alias("above"), F.col("above").alias("_above"))
        state = scratch.keep(
            state.join(given, "key", "left")
            .join(farther, "above", "left")
            .withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in sums})
            .withColumns({"least": F.least("least", "_least"), "above": F.col("_above")})
            .drop("_above", "_least", *(f"_{c}" for c in sums)),
            f"sums{round_}",
        )
        scratch.drop(f"sums{round_ - 1}")
    return state.drop("above")


IDS_SCHEMA = pa.schema([("key", pa.binary()), ("from", pa.int64()), ("ids", pa.string())])
DIGEST = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])


def _listed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv) as comma-joined ids, IDS of them at most in a row."""

    def rows():
        held: list[int] = []
        last = None
        for batch in parts:
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (key != last or len(held) == IDS):
                    yield last, held[0], ",".join("" if x == NO_ID else str(x) for x in held)
                    held = []
                last = key
                held.append(conv)
        if held:
            yield last, held[0], ",".join("" if x == NO_ID else str(x) for x in held)

    return batches(rows(), IDS_SCHEMA)


def _digested(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        last, digest = None, None
        for batch in parts:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2)):
                if key != last:
                    if digest:
                        yield last, digest.hexdigest()
                    last, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.as_py().encode())
        if digest:
            yield last, digest.hexdigest()

    return batches(rows(), DIGEST)


def _end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each key. Ids are sorted and joined in ranges of any size; only the
    joined texts of one key, thousands of ids each, pass through one task, in order and one at a time."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        ends.repartitionByRange(parts, "key", "conv")
        .sortWithinPartitions("key", "conv")
        .mapInArrow(_listed, "key binary, from long, ids string")
        .repartition(parts, "key")
        .sortWithinPartitions("key", "from")
        .mapInArrow(_digested, "key binary, ends_sha256 string")
    )


def prefix_trie(conversations: DataFrame, scratch: Scratch, base: Column | None = None, history: Column | None = None) -> DataFrame:
    """A row per distinct prefix of a conversation, the empty one included; see ``paths`` for the arguments.

    conv_id: the smallest member, that is conversation with this prefix; depth; parent_conv_id: the parent's
    conv_id; n_convs: members; n_children; n_leaves: childless nodes of the subtree; saved_tokens: the sum
    over the subtree of (n_convs - 1) times the bytes of the last text; ends_sha256: digest of the members that
    are no longer than the prefix, ascending and comma-joined.

    The compacted trie is built and summed; only then its edges become a row per prefix. Prefixes on an edge
    have the members and leaves of the node below, and what they save follows from its sums.

    Turns are in the order of turn (NULL first), role, digest; NULL roles and texts are empty. NULL conv_ids
    are one conversation, below all others and with an empty decimal. Repeated rows are turns of their own.
    An empty table gives no row.
    """
    paths_ = paths(conversations, scratch, base, history)
    nodes = compacted(paths_, scratch)
    ended = paths_.where("ends").select(F.col("hash").alias("key"), "conv")
    by_key = scratch.keep(ended.groupBy("key").agg(F.count("*").alias("n"), F.min("conv").alias("least")), "ended")
    zero = F.lit(0).cast("long")
    root = ended.limit(1).select(
        F.lit(ROOT).alias("key"), zero.alias("len"), F.lit(-1).cast("long").alias("up"),
        F.lit(None).cast("binary").alias("parent"), F.col("conv").alias("rep"), zero.alias("before"), zero.alias("total"),
    )
    columns = ["key", "len", "up", "parent", "rep", "before", "total"]
    tree = nodes.select(columns).unionByName(root)
    ways = nodes.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("ways"))
    summed = _summed(
        tree.join(by_key, "key", "left")
        .join(ways, "key", "left")
        .select(
            *columns,
            "least",
            F.coalesce("ways", zero).alias("ways"),
            F.coalesce("n", zero).alias("n"),
            F.col("ways").isNull().cast("long").alias("leaves"),
            (F.coalesce("n", zero) * F.col("total")).alias("weighed"),
            (F.col("total") - F.col("before")).alias("alone"),
        ),
        scratch,
    )
    digests = scratch.keep(_end_digests(ended), "digests")
    above = summed.select(F.col("key").alias("parent"), F.col("least").alias("parent_least"))
    edges = (
        summed.join(above, "parent", "left")
        .join(digests, "key", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    )
    inner = _depths(edges.where("len > 0"), F.col("up") + 1, F.col("len")).join(
        _at(paths_, "rep", "depth", _b="bytes", _s="size"), ["rep", "depth"]
    )
    top = edges.where("len = 0").withColumns({"depth": zero, "_b": zero, "_s": zero})
    here = F.col("_b") - F.col("_s")  # bytes above this prefix's last text
    bottom = F.col("depth") == F.col("len")
    return inner.unionByName(top).select(
        id_of("least").alias("conv_id"),
        "depth",
        F.when(F.col("depth") == 0, None)
        .otherwise(_of(F.when(F.col("depth") == F.col("up") + 1, F.col("parent_least")).otherwise(F.col("least"))))
        .alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(bottom, F.col("ways")).otherwise(F.lit(1).cast("long")).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("weighed") - F.col("n") * here - F.col("alone") + here - F.col("before")).alias("saved_tokens"),
        F.when(bottom, F.col("ends_sha256")).otherwise(F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def _of(key: Column) -> Column:
    return F.when(key != NO_ID, key)
