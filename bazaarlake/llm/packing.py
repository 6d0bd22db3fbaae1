"""Packing token pieces into sequences: dominance reduction on the histogram of lengths, then best fit."""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlake.llm.common import Scratch, batches, id_key, id_of, of_worker, with_offsets

CAPACITY = 4096
END_OF_DOCUMENT = 1

# -- tokens ---------------------------------------------------------------------------------------------

#: In a text of these characters alone, the tokenizer's lower case, normal form and split are those of SPLIT.
PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
#: The tokenizer's own split, for lower-case texts of PLAIN characters. Its contractions.
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^\\sa-zà-öø-ÿß0-9]+")
#: Strings whose ids a worker remembers; beyond that it starts anew.
REMEMBERED = 1_000_000


class Remembered(dict):
    """Ids of the strings between white space, made once each."""

    def __init__(self, model, letters: dict[int, str]) -> None:
        super().__init__()
        self.model, self.letters = model, letters

    def __missing__(self, chunk: str) -> bytes:
        tokens = [t.id for word in SPLIT.findall(chunk) for t in self.model.tokenize(word.translate(self.letters))]
        if len(self) >= REMEMBERED:
            self.clear()
        self[chunk] = ids = struct.pack(f"<{len(tokens)}I", *tokens)
        return ids


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    The model works word by word and no word spans white space, so ids are looked up by the strings between;
    a text with characters whose normal form or split is not certain, or that may hold a special token, goes
    through the tokenizer as a whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.remembered = Remembered(self.tokenizer.model, letters)

    def encode(self, text: str) -> bytes:
        if "<|" not in text and PLAIN.fullmatch(text):
            return b"".join(map(self.remembered.__getitem__, text.lower().split()))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


PIECE = pa.schema(
    [("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)
PIECE_DDL = "id long, piece int, start long, length long, ids_crc32 long"


def cut(path: str, capacity: int, end: int):
    """Documents to pieces of at most ``capacity`` ids, each document followed by ``end``."""

    def pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = of_worker(("encoder", path), lambda: Encoder(path)).encode, np.array([end], "<u4").tobytes()

        def rows():
            for part in parts:
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    coded = encode(text.as_py()) + last
                    for piece, at in enumerate(range(0, len(coded), 4 * capacity)):
                        own = coded[at : at + 4 * capacity]
                        yield doc, piece, at // 4, len(own) // 4, zlib.crc32(own)

        yield from batches(rows(), PIECE)

    return pieces


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END_OF_DOCUMENT) -> DataFrame:
    """id, piece, start, length, ids_crc32 of every piece; NULL text is empty and still has its end."""
    rows = docs.select(id_key().alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut(tokenizer, capacity, end), PIECE_DDL)


# -- the plan -------------------------------------------------------------------------------------------


def dominating_set(length: int, lengths: list[int], count: Counter, capacity: int) -> list[int] | None:
    """What an optimal packing may put beside the longest piece, or None if no small set is proven.

    ``lengths`` are those left, rising. A sequence that holds the longest piece is dominated by {longest,
    others} if whatever else could lie with it can be exchanged for the others without needing more room:
    nothing fits beside it; or its best single partner fills the rest exactly; or only one more piece fits,
    so that the best single partner dominates every other choice; or two fit at most, and the best pair is
    not smaller in either piece than any other pair.
    """
    room = capacity - length
    at = bisect_left(lengths, room + 1) - 1
    if at < 0:
        return []
    best = lengths[at]
    if best == room:
        return [best]
    smallest = lengths[0]
    second = smallest if count[smallest] > 1 else lengths[1] if len(lengths) > 1 else None
    if second is None or smallest + second > room:
        return [best]
    third = _third_smallest(lengths, count)
    if third is None or smallest + second + third > room:
        # Two more fit at most: the longest partner with its own best mate dominates if no pair is larger
        # in its second piece, that is if the mate is the largest piece any pair may have as its smaller.
        left = bisect_left(lengths, room - best + 1) - 1
        if left >= 0:
            mate = lengths[left]
            if mate == best and count[best] < 2:
                mate = lengths[left - 1] if left else None
            if mate is not None and best + mate == room and mate >= _largest_smaller(lengths, count, room):
                return [best, mate]
    return None


def _third_smallest(lengths: list[int], count: Counter) -> int | None:
    seen = 0
    for x in lengths[:3]:
        seen += count[x]
        if seen >= 3:
            return x
    return None


def _largest_smaller(lengths: list[int], count: Counter, room: int) -> int:
    """The largest piece that is the smaller one of any pair within ``room``."""
    at = bisect_left(lengths, room // 2 + 1) - 1
    if at < 0:
        return 0
    x = lengths[at]
    if count[x] > 1 or (at + 1 < len(lengths) and x + lengths[at + 1] <= room):
        return x
    return lengths[at - 1] if at else 0


Sequences = list[tuple[tuple[int, ...], int]]


def reduce(count: Counter, capacity: int = CAPACITY) -> Sequences:
    """The dominance reduction: sequences that an optimal packing may have, taken out of ``count``.

    From the longest length down, as long as a piece has a dominating partner set among all pieces that are
    left, sequences of it are fixed, as many at once as there are pieces for. A piece without one is set
    aside and the next length is tried; partners of shorter pieces may be among those set aside. What is
    fixed shrinks the instance, so passes follow until one fixes nothing.
    """
    lengths = sorted(count)
    done: Sequences = []

    def take(length: int, n: int) -> None:
        count[length] -= n
        if not count[length]:
            del count[length]
            lengths.pop(bisect_left(lengths, length))

    def partners_of(length: int) -> list[int] | None:
        """Of one piece, among all the others."""
        take(length, 1)
        partners = dominating_set(length, lengths, count, capacity)
        if length not in count:
            insort(lengths, length)
        count[length] += 1
        return partners

    fixed = True
    while fixed:
        fixed = False
        for length in lengths[::-1]:
            while count.get(length) and (partners := partners_of(length)) is not None:
                members = Counter([length, *partners])
                # As long as every length of the set has pieces, the same choice is made again.
                alike = min(count[x] // k for x, k in members.items())
                alike = max(1, alike - 1) if partners and partners[-1] != capacity - length else max(1, alike)
                for x, k in members.items():
                    take(x, k * alike)
                done.append(((length, *partners), alike))
                fixed = True
    return done


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Sequences:
    """Sequences as (lengths, how many alike) for pieces given by length and number.

    First the reduction (see ``reduce``), then best fit for what it leaves, longest first, over open
    sequences grouped by the room they have left. The work depends on the number of different lengths, never
    on the number of pieces.
    """
    count = Counter({k: n for k, n in histogram.items() if n > 0})
    done = reduce(count, capacity)
    lengths = sorted(count)
    rooms: list[int] = []
    open_: dict[int, list[list]] = {}

    def put(room: int, members: tuple[int, ...], n: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append([members, n])

    for length in reversed(lengths):
        n = count[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                full, rest = divmod(n, each)
                if full:
                    put(capacity - each * length, (length,) * each, full)
                if rest:
                    put(capacity - rest * length, (length,) * rest, 1)
                break
            room = rooms[at]
            members, there = open_[room][-1]
            used = min(n, there)
            if used == there:
                open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            else:
                open_[room][-1][1] -= used
            put(room - length, (*members, length), used)
            n -= used
    for groups in open_.values():
        done += [(tuple(members), n) for members, n in groups]
    return done


def slots(sequences: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: from which rank on (rising), first sequence, how many alike, offset inside.

    The pieces of one length get ranks; ranks [from, from + alike) are the k-th members of sequences first,
    first + 1, ... An entry stands for any number of pieces.
    """
    held: dict[int, list[tuple[int, int, int]]] = {}
    ranked: Counter = Counter()
    first = 0
    for members, alike in sequences:
        at = 0
        for length in members:
            held.setdefault(length, []).append((ranked[length], first, at))
            ranked[length] += alike
            at += length
        first += alike
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in held.items()}


# -- packing --------------------------------------------------------------------------------------------

#: Parts in which the pieces of one length are ranked.
BUCKETS = 4096


def place(table: dict[int, tuple[np.ndarray, ...]]):
    def placed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lengths, ranks = part.column("length").to_numpy(), part.column("rank_before").to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                start, first, at = table[int(length)]
                k = np.searchsorted(start, ranks[own], "right") - 1
                sequence[own] = first[k] + ranks[own] - start[k]
                offset[own] = at[k]
            columns = [part.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)],
                ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return placed


def pack(docs: DataFrame, scratch: Scratch, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and the offset there.

    Which pieces lie together depends on lengths alone, so only their histogram, ``capacity`` rows at most,
    comes to the driver; the plan over it goes back to the tasks and is bounded by the same number, whatever
    the corpus. Pieces of one length are ranked in BUCKETS parts, as one length may be very common.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. NULL or empty text gives one
    piece of one id; NULL ids are kept; repeated rows are packed each; an empty table gives none. Of equal
    lengths, which document comes first follows a hash of its id.
    """
    pieces = scratch.keep(pieces_of(docs, tokenizer, capacity), "pieces")
    lengths = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # capacity rows at most
    table = slots(plan({r["length"]: r["n"] for r in lengths}, capacity))
    ranked = with_offsets(
        pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(BUCKETS))),
        ["length"],
        "bucket",
        [F.col("id"), F.col("piece"), F.col("ids_crc32"), F.col("start")],
        {"rank": F.lit(1)},
    )
    return ranked.mapInArrow(place(table), f"{PIECE_DDL}, sequence_id long, offset long").select(
        id_of("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
