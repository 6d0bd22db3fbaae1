"""Repeated passages: suffixes at chosen places, range-partitioned, sorted in buckets, compared across edges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlake.llm.common import Scratch, batches, id_key, id_of

#: Bytes of a repeated string.
LENGTH = 400
#: A suffix is taken at the smallest of STARTS neighbouring hashes of GRAM bytes. A string of LENGTH bytes has
#: that many starts, so equal strings have a suffix at the same place, and it leads with LEAD bytes of them.
GRAM, STARTS = 16, 288
LEAD = LENGTH - STARTS + 1
#: Texts, in bytes, that are worked on at once, and bytes in a bucket of suffixes.
AT_ONCE, BUCKET = 1_000_000, 24_000_000
#: Bytes of a slice of a long text.
SLICE = 1_000_000

_rng = np.random.default_rng(20_240_301)
BYTE = _rng.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(STEP), -1, 2**64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Rolling:
    """Hashes of all strings of any one length within a byte string, each in a few operations."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[data] * powers(STEP, n), out=self.sums[1:], dtype=np.uint64)
        self.back = powers(BACK, n + 1)

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        h = (self.sums[starts + length] - self.sums[starts]) * self.back[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, from least values up to and from block edges."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, width)
    to_here = np.minimum.accumulate(grid, axis=1).ravel()
    from_here = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(from_here[:n], to_here[width - 1 : width - 1 + n])


def self_repeats(
    rolling: Rolling, starts: np.ndarray, text: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray, lead: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes whose windows all occur earlier in their text, and of every window start whether it is repeated so.

    The windows of a suffix are held against those as far from the last suffix before it with the same lead. If all
    are equal, all of them are decided, and the windows before stay to be found by other texts.
    """
    size, of = last - first + 1, text[first]
    order = np.lexsort((place, lead, of))
    same = np.flatnonzero((of[order][1:] == of[order][:-1]) & (lead[order][1:] == lead[order][:-1]))
    near = order[same + 1]
    step = np.zeros(len(first), np.int64)
    step[near] = place[near] - place[order[same]]
    repeated = np.zeros(len(starts), bool)
    whole = np.zeros(len(first), bool)
    if not len(near):
        return whole, repeated
    group = np.repeat(np.arange(len(near)), size[near])
    at = np.arange(len(group)) - np.repeat(np.cumsum(size[near]) - size[near], size[near]) + first[near][group]
    before = at - step[near][group]
    # Starts of one text are neighbours, so a start some places before is that many bytes before, or of another text.
    inside = before >= 0
    inside[inside] = text[before[inside]] == text[at[inside]]
    equal = inside.copy()
    equal[inside] = rolling.at(starts[at[inside]], LENGTH) == rolling.at(starts[before[inside]], LENGTH)
    repeated[at[equal]] = repeated[before[equal]] = True
    whole[near] = np.bincount(group[equal], minlength=len(near)) == size[near]
    return whole, repeated


def anchors(texts: list[bytes]) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Of every window of LENGTH bytes its suffix: text, place, first and last window start, hash of the lead.

    Windows that occur earlier in their text may have none; second, runs of repeated windows that were
    found so: text, first and last start.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),), tuple(np.zeros(0, np.int64) for _ in range(3))
    if len(data) < LENGTH:
        return none
    ends = np.cumsum([len(t) for t in texts])
    rolling = Rolling(data)
    grams = np.arange(len(data) - GRAM + 1)
    ranked = (rolling.at(grams, GRAM) & np.uint64(0xFFFFFFFF00000000)) | grams.astype(np.uint64)
    starts = np.arange(len(data) - LENGTH + 1)
    text = np.searchsorted(ends, starts, "right")
    chosen = (sliding_least(ranked, STARTS)[: len(starts)] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = starts + LENGTH <= ends[text]
    starts, text, chosen = starts[inside], text[inside], chosen[inside]
    if not len(starts):
        return none
    first = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[first[1:], len(starts)] - 1
    begin = np.r_[0, ends[:-1]]
    place = chosen[first]
    lead = rolling.at(place, LEAD)
    whole, repeated = self_repeats(rolling, starts, text, first, last, place, lead)
    new = np.r_[True, (text[1:] != text[:-1])]
    lo = np.flatnonzero(repeated & (new | ~np.r_[False, repeated[:-1]]))
    hi = np.flatnonzero(repeated & (np.r_[new[1:], True] | ~np.r_[repeated[1:], False]))
    known = text[lo], starts[lo] - begin[text[lo]], starts[hi] - begin[text[lo]]
    first, last, place, lead = (x[~whole] for x in (first, last, place, lead))
    of = text[first]
    return (of, place - begin[of], starts[first] - begin[of], starts[last] - begin[of], lead), known


#: A suffix, or (lead and place NULL) a run of window starts that its own text repeats.
ANCHOR = pa.schema(
    [(c, pa.int64()) for c in ("lead", "id", "copy")] + [(c, pa.int32()) for c in ("place", "lo", "hi")]
)


def _anchored(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(ids: list[int], copies: list[int], offsets: list[int], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        (text, place, lo, hi, lead), (own, begin, end) = anchors(texts)
        of = [np.array(column, np.int64) for column in (ids, copies, offsets)]
        at = of[2][text]
        none = pa.nulls(len(own), pa.int64())
        for columns in (
            (lead.view(np.int64), of[0][text], of[1][text], place + at, lo + at, hi + at),
            (none, of[0][own], of[1][own], none, begin + of[2][own], end + of[2][own]),
        ):
            arrays = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, ANCHOR)]
            yield pa.RecordBatch.from_arrays(arrays, schema=ANCHOR)

    held: tuple[list, ...] = ([], [], [], [])
    size = 0
    for part in parts:
        for id_, copy, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
            data = text.as_py().encode()
            # Each window of a long text starts in one slice and lies in it.
            for offset in range(0, len(data) - LENGTH + 1, SLICE):
                own = data[offset : offset + SLICE + LENGTH - 1]
                for column, value in zip(held, (id_, copy, offset, own)):
                    column.append(value)
                size += len(own)
                if size > AT_ONCE:
                    yield from out(*held)
                    held, size = ([], [], [], []), 0
    if held[0]:
        yield from out(*held)


SUFFIX = pa.schema(
    [("suffix", pa.binary()), ("id", pa.int64()), ("copy", pa.int64()), ("lo", pa.int32()), ("context", pa.binary())]
    + [("at", pa.int32())]
)


def _contexts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every suffix with the windows around it, for texts with the places of their suffixes."""

    def rows():
        for part in parts:
            for id_, copy, text, places in zip(
                part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3)
            ):
                data = text.as_py().encode()
                for p in places.as_py():
                    context = data[p["lo"] : p["hi"] + LENGTH]
                    yield data[p["place"] : p["place"] + LEAD], id_, copy, p["lo"], context, p["place"] - p["lo"]

    yield from batches(rows(), SUFFIX)


def multikey_quicksort(leads: list[bytes]) -> np.ndarray:
    """The order of byte strings of one length: parts by one eight-byte digit at a time, in three ways."""
    width = -(-len(leads[0]) // 8) if leads else 0
    padded = b"".join(x.ljust(8 * width, b"\0") for x in leads)
    digits = np.frombuffer(padded, ">u8").reshape(len(leads), width).astype(np.uint64)
    order, stack = [], [(np.arange(len(leads)), 0)]
    while stack:
        own, depth = stack.pop()
        if len(own) < 2 or depth == width:
            order.append(own)
            continue
        key = digits[own, depth]
        some = np.sort(key[:: len(key) // 31 + 1])
        pivot = some[len(some) // 2]
        stack += [(own[key > pivot], depth), (own[key == pivot], depth + 1), (own[key < pivot], depth)]
    return np.concatenate(order) if order else np.zeros(0, np.int64)


#: A run of window starts to remove; a window of a run at an edge, with its start if it is alone; or the bytes that
#: BLOCK neighbouring windows at an edge have in common, with their starts if nothing else in the bucket has them.
REPEATED, AT_EDGE, CORE = 0, 1, 2
BLOCK = 16
FOUND = pa.schema(
    [("kind", pa.int8()), ("hash", pa.int64()), ("again", pa.int64()), ("alone", pa.bool_())]
    + [(c, pa.int64()) for c in ("id", "copy", "lo", "hi")]
)
FOUND_DDL = "kind tinyint, hash long, again long, alone boolean, id long, copy long, lo long, hi long"


def _windows(members: list[int], run: np.ndarray, edge: np.ndarray, held: tuple[list, ...]) -> Iterator[pa.RecordBatch]:
    """What the windows of some runs tell. run and edge: of each member its run, and whether it is at an edge."""
    suffixes, ids, copies, los, contexts, ats = held
    own = [contexts[i] for i in members]
    lengths = np.array([len(c) for c in own])
    sizes = lengths - LENGTH + 1
    which = np.repeat(np.arange(len(own)), sizes)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    data = np.frombuffer(b"".join(own), np.uint8)
    rolling = Rolling(data)
    hashes = rolling.at((np.cumsum(lengths) - lengths)[which] + inner, LENGTH)
    _, once, back, counts = np.unique(
        hashes + run[which].astype(np.uint64) * STEP, return_index=True, return_inverse=True, return_counts=True
    )
    twice = counts[back] > 1
    start = np.array([los[i] for i in members], np.int64)
    id_, copy = (np.array([column[i] for i in members], np.int64) for column in (ids, copies))

    def batch(kind: int, at: np.ndarray, to: np.ndarray, hash_: np.ndarray, again: np.ndarray, alone: np.ndarray):
        m = which[at]
        columns = (np.full(len(at), kind, np.int8), hash_, again, alone, id_[m], copy[m], start[m] + inner[at], start[m] + inner[to])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND)], schema=FOUND)

    new = np.r_[True, which[1:] != which[:-1]]
    begins = np.flatnonzero(twice & (new | ~np.r_[False, twice[:-1]]))
    ends = np.flatnonzero(twice & (np.r_[new[1:], True] | ~np.r_[twice[1:], False]))
    none = np.zeros(len(begins), np.int64)
    yield batch(REPEATED, begins, ends, none, none, none.astype(bool))
    if edge.any():
        lead = {r: suffixes[members[k]] for k, r in enumerate(run.tolist()) if edge[k]}
        digest = {
            r: int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for r, x in lead.items()
        }
        # Equal windows lie alike around their leads, so they are in the same block and have its core in common.
        at = np.array([ats[i] for i in members], np.int64)
        near = np.flatnonzero(edge[which])
        block = (inner[near] - at[which[near]] + STARTS) // BLOCK
        first = np.flatnonzero(np.r_[True, (which[near][1:] != which[near][:-1]) | (block[1:] != block[:-1])])
        last = np.r_[first[1:], len(near)] - 1
        m, block = which[near[first]], block[first]
        cores = rolling.at((np.cumsum(lengths) - lengths)[m] + at[m] - STARTS + BLOCK * (block + 1) - 1, LENGTH - BLOCK + 1)
        _, told, same, counts = np.unique(
            cores + (run[m] * STARTS + block).astype(np.uint64) * STEP, return_index=True, return_inverse=True, return_counts=True
        )
        lone = counts[same] == 1
        again = np.array([digest[r] for r in run[m].tolist()], np.int64)
        yield batch(CORE, near[first[told]], near[last[told]], cores[told].view(np.int64), again[told], lone[told])
        shared = np.zeros(len(which), bool)
        shared[near] = np.repeat(~lone, last - first + 1)
        once = once[shared[once]]
        again = np.array([digest[r] for r in run[which[once]].tolist()], np.int64)
        yield batch(AT_EDGE, once, once, hashes[once].view(np.int64), again, ~twice[once])


TOLD = pa.schema([(c, pa.int64()) for c in ("again", "hash", "id", "copy", "lo")])


def _told(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The single windows of blocks whose core another bucket has too."""

    def rows():
        for part in parts:
            for id_, copy, text, blocks in zip(
                part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3)
            ):
                data = text.as_py().encode()
                for b in blocks.as_py():
                    own = Rolling(np.frombuffer(data[b["lo"] : b["hi"] + LENGTH], np.uint8))
                    hashes = own.at(np.arange(b["hi"] - b["lo"] + 1), LENGTH).view(np.int64)
                    for n, h in enumerate(hashes.tolist()):
                        yield b["again"], h, id_, copy, b["lo"] + n

    yield from batches(rows(), TOLD)


def _bucket(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort one bucket's suffixes, and find in each run of equal leads the windows that occur twice."""
    held: tuple[list, ...] = ([], [], [], [], [], [])
    for part in parts:
        for i, column in enumerate(held):
            column += part.column(i).to_pylist()
    suffixes, contexts = held[0], held[4]
    if not suffixes:
        return
    order = multikey_quicksort(suffixes).tolist()
    edges = (suffixes[order[0]], suffixes[order[-1]])
    members: list[int] = []
    run: list[int] = []
    edge: list[bool] = []
    start = n = size = 0
    while start < len(order):
        lead, stop = suffixes[order[start]], start + 1
        while stop < len(order) and suffixes[order[stop]] == lead:
            stop += 1
        at_edge = lead in edges
        if stop - start > 1 or at_edge:
            own = order[start:stop]
            members += own
            run += [n] * len(own)
            edge += [at_edge] * len(own)
            size += sum(len(contexts[i]) for i in own)
            n += 1
        start = stop
        if size > AT_ONCE:
            yield from _windows(members, np.array(run), np.array(edge), held)
            members, run, edge, size = [], [], [], 0
    if members:
        yield from _windows(members, np.array(run), np.array(edge), held)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans, from and to, covered by windows that start in the runs."""
    spans: list[list[int]] = []
    for lo, hi in sorted(runs):
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi + LENGTH)
        else:
            spans.append([lo, hi + LENGTH])
    return [tuple(s) for s in spans]


CUT_DDL = (
    "id long, copy long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<from:long,to:long>>, kept string"
)


def _cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("id", pa.int64()), ("copy", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())]
        + [("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))]
        + [("kept", pa.string())]
    )

    def rows():
        for part in parts:
            for id_, copy, text, runs in zip(
                part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3)
            ):
                data = text.as_py().encode()
                spans = merged([(r["lo"], r["hi"]) for r in runs.as_py()])
                digest, at, kept = hashlib.sha256(), 0, []
                for lo, hi in (*spans, (len(data), len(data))):
                    digest.update(data[at:lo])
                    # Piece by piece: what is left of two characters makes no third one.
                    kept.append(data[at:lo].decode(errors="ignore"))
                    at = hi
                removed = sum(hi - lo for lo, hi in spans)
                cut = [{"from": lo, "to": hi} for lo, hi in spans]
                yield id_, copy, removed, len(spans), digest.hexdigest(), cut, "".join(kept)

    yield from batches(rows(), schema)


def repeated_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the spans (from, to) of every document."""
    return without_repeats(docs, scratch).drop("text")


def without_repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, the spans (from, to) and the remaining text of every document.

    n_bytes is the size of the input. The text is made of the remaining bytes, but for characters that an edge of
    a span cuts: what is left of them is no text and stays in the digest only.

    A byte goes if a string of LENGTH bytes that covers it starts anywhere else. Equal texts need no search:
    all their bytes go if they have LENGTH; one of each goes on. A suffix at every byte would be many times
    the corpus, so suffixes are taken where a hash of the next bytes is the smallest around: equal strings
    have one at the same place. Those whose lead occurs once are left out. The others go, with the bytes
    around them, to range partitions by lead, document and place, whose splitters are sampled; a bucket
    sorts them by multikey quicksort and compares the windows of each run of equal leads. A very common lead
    lies in many buckets: what the runs at their edges have is grouped once more by hashes, first of what
    16 neighbouring windows have in common, and where several buckets have that, of the windows.
    Text that repeats itself (rulers, padding, tables) would have a suffix every few bytes. It is decided where it is
    read; its first windows go on, by which other texts find it. Long texts are worked on in slices of SLICE bytes.

    Works on UTF-8 bytes of whole texts. NULL text is empty. NULL ids and repeated rows are documents of
    their own, a repeated row repeats its text. An empty table gives none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(id_key().alias("id"), F.xxhash64(text).alias("copy"), text.alias("text"))
    meta = scratch.keep(
        rows.select(
            "id",
            "copy",
            F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
            F.octet_length("text").cast("long").alias("n"),
        ),
        "meta",
    )
    texts = scratch.keep(
        meta.where(F.col("n") >= LENGTH)
        .groupBy("digest")
        .agg(F.min(F.struct("id", "copy")).alias("first"), F.count("*").alias("times"))
        .select("digest", "first.id", "first.copy", "times"),
        "texts",
    )
    places = scratch.keep(
        rows.mapInArrow(_anchored, "lead long, id long, copy long, place int, lo int, hi int"), "places"
    )
    own = places.where("lead IS NULL").select("id", "copy", "lo", "hi")
    common = scratch.keep(
        places.where("lead IS NOT NULL")
        .select("lead", F.xxhash64("copy", "place").alias("at"))
        .groupBy("lead")
        .agg(F.min("at").alias("a"), F.max("at").alias("b"))
        .where("a != b")
        .select("lead"),
        "common",
    )
    wanted = scratch.keep(
        places.join(common.hint("merge"), "lead")
        .select("id", "copy", F.struct("place", "lo", "hi").alias("p"))
        .unionByName(own.select("id", "copy"), allowMissingColumns=True)
        .groupBy("id", "copy")
        .agg(F.collect_set("p").alias("places"))  # a suffix every few dozen bytes of the text
        .join(texts.select("id", "copy", "times").hint("merge"), ["id", "copy"]),
        "wanted",
    )
    suspects = scratch.keep(
        rows.join(wanted.hint("merge"), ["id", "copy"]).select("id", "copy", "text", "places", "times"), "suspects"
    )
    size = suspects.select(F.sum(F.size("places")).alias("n")).first()["n"] or 0
    buckets = max(
        int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size * (LENGTH + STARTS + LEAD) // BUCKET + 1
    )
    found = scratch.keep(
        suspects.select("id", "copy", "text", "places")
        .mapInArrow(_contexts, "suffix binary, id long, copy long, lo int, context binary, at int")
        .repartitionByRange(buckets, "suffix", "id", "copy", "lo")
        .mapInArrow(_bucket, FOUND_DDL),
        "found",
    )
    of_more = (
        found.where(F.col("kind") == CORE)
        .groupBy("again", "hash")
        .agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("alone"), F.struct("id", "copy", "lo", "hi"))).alias("own"))
        .where("n > 1")  # a bucket tells a core once, and a window once, so there are as many as buckets at most
        .select("again", F.explode("own").alias("o"))
        .groupBy("o.id", "o.copy")
        .agg(F.collect_list(F.struct("again", "o.lo", "o.hi")).alias("blocks"))
    )
    single = (
        suspects.select("id", "copy", "text")
        .join(of_more.hint("merge"), ["id", "copy"])
        .mapInArrow(_told, "again long, hash long, id long, copy long, lo long")
        .withColumns({"alone": F.lit(True), "hi": F.col("lo")})
    )
    across = (
        found.where(F.col("kind") == AT_EDGE)
        .drop("kind")
        .unionByName(single)
        .groupBy("again", "hash")
        .agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("alone"), F.struct("id", "copy", "lo", "hi"))).alias("own"))
        .where("n > 1")
        .select(F.explode("own").alias("o"))
        .select("o.id", "o.copy", "o.lo", "o.hi")
    )
    runs = (
        found.where(F.col("kind") == REPEATED)
        .select("id", "copy", "lo", "hi")
        .unionByName(across)
        .unionByName(own.select("id", "copy", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi")))
        .groupBy("id", "copy")
        .agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    )
    cut = scratch.keep(
        suspects.where("times = 1")
        .select("id", "copy", "text")
        .join(runs.hint("merge"), ["id", "copy"])
        .mapInArrow(_cut, CUT_DDL),
        "cut",
    )
    gone = (F.col("times") > 1) & (F.col("n") >= LENGTH)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("n").alias("to")))
    # Rows with the same id and text have the same outcome, so texts move once, to their outcomes.
    outcomes = (
        meta.dropDuplicates(["id", "copy"])
        .join(texts.select("digest", "times").hint("merge"), "digest", "left")
        .join(cut.hint("merge"), ["id", "copy"], "left")
    )
    return rows.join(outcomes.hint("merge"), ["id", "copy"]).select(
        id_of("id").alias("doc_id"),
        F.col("n").alias("n_bytes"),
        F.when(gone, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256))
        .otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest"))))
        .alias("kept_sha256"),
        F.when(gone, whole).otherwise(F.col("spans")).alias("spans"),
        F.when(gone, F.lit("")).otherwise(F.coalesce("kept", "text")).alias("text"),
    )
