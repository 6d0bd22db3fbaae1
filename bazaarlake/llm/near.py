"""Near-duplicates by MinHash: a multi-index Hamming join of signatures, confirmed on whole sets."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarlake.llm.common import Scratch, batches, id_key, id_of
from bazaarlake.llm.components import components

#: Symbols of 16 bits in a signature.
N_SYMBOLS = 60


class Likeness(NamedTuple):
    """What links two texts, and how such pairs are found.

    A signature has ``chunks`` chunks of ``symbols`` symbols. Pairs with fewer than 2 * chunks different
    symbols have a chunk with one at most, and are found by leaving out each symbol of each chunk in turn.
    Pairs with more than ``distance`` different symbols are dropped before their sets are compared.
    """

    shingle: int  # words
    percent: int  # of the union
    chunks: int
    symbols: int
    distance: int


#: The query's: at 85 % a pair has two different symbols in every chunk with a probability of 3e-7, and more than
#: 24 of 60 with 6e-7.
QUERY = Likeness(3, 85, 10, 6, 24)
#: That of corpora: at 80 % two in every chunk with 1.1e-7, and more than 30 of 60 with 5e-8.
CORPUS = Likeness(5, 80, 12, 5, 30)

_rng = np.random.default_rng(20_240_229)
_odd = lambda shape: _rng.integers(0, 2**63, shape, np.uint64) * np.uint64(2) + np.uint64(1)
MULTIPLY, ADD = _odd(N_SYMBOLS), _odd(N_SYMBOLS)
KEY = _odd(N_SYMBOLS)
LEFT_OUT = _odd(N_SYMBOLS)
FOLLOW = _odd(max(QUERY.shingle, CORPUS.shingle))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, made once each."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingles(text: str, hashes: WordHashes, size: int) -> np.ndarray:
    """The set of a text's shingles as sorted hashes; with fewer words the whole sequence is one."""
    words = text.encode().lower().split()
    coded = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(words):
        return coded
    n = max(1, len(words) - size + 1)
    rolled = np.full(n, len(words) if len(words) < size else 0, np.uint64)
    for k in range(min(size, len(words))):
        rolled = rolled * FOLLOW[k] + coded[k : k + n]
    return np.unique(mixed(rolled))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of symbols for every set, none of them empty."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    flat = np.concatenate(sets)
    least = [np.minimum.reduceat(flat * MULTIPLY[j] + ADD[j], starts) for j in range(N_SYMBOLS)]
    return (mixed(np.stack(least, axis=1)) >> np.uint64(48)).astype("<u2")


DOC = pa.schema(
    [("id", pa.int64()), ("copy", pa.int64()), ("set", pa.binary()), ("n", pa.int64()), ("signature", pa.binary())]
)
#: Texts, in characters, whose sets are held at once.
AT_ONCE = 4_000_000


def _fingerprints(like: Likeness, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()

    def rows(held: list[tuple[int, int, np.ndarray]]):
        full = [s for _, _, s in held if len(s)]
        signed = iter(signatures(full)) if full else iter(())
        for id_, copy, s in held:
            digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            yield id_, copy, digest, len(s), next(signed).tobytes() if len(s) else None
        if len(hashes) > 1_000_000:
            hashes.clear()

    def all_rows():
        held, size = [], 0
        for part in parts:
            for id_, copy, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                text = text.as_py()
                held.append((id_, copy, shingles(text, hashes, like.shingle)))
                size += len(text)
                if size > AT_ONCE:
                    yield from rows(held)
                    held, size = [], 0
        yield from rows(held)

    yield from batches(all_rows(), DOC)


def _keys(like: Likeness, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every set under each of its chunks with each symbol left out."""
    key, left_out = (x.reshape(like.chunks, like.symbols) for x in (KEY, LEFT_OUT))
    for part in parts:
        if not part.num_rows:
            continue
        sids = part.column(0).to_numpy()
        symbols = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").reshape(-1, like.chunks, like.symbols)
        weighed = mixed(symbols.astype(np.uint64) + key) * key
        rest = weighed.sum(axis=2, keepdims=True, dtype=np.uint64) - weighed
        keys = mixed(rest + left_out).reshape(len(sids), -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(sids, keys.shape[1]))], ["key", "sid"]
        )


def _close(like: Likeness, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures differ in few enough symbols."""
    for part in parts:
        if not part.num_rows:
            continue
        a, b = (
            np.frombuffer(b"".join(part.column(i).to_pylist()), "<u2").reshape(-1, N_SYMBOLS) for i in (2, 3)
        )
        near = (a != b).sum(axis=1) <= like.distance
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(near))


def _packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        texts = [zlib.compress(t.as_py().encode(), 1) for t in part.column(1)]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary())], ["sid", "packed"])


def _unpacked(packed: bytes, hashes: WordHashes, size: int) -> np.ndarray:
    if len(hashes) > 1_000_000:
        hashes.clear()
    return shingles(zlib.decompress(packed).decode(), hashes, size)


def _linked(like: Likeness, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose whole sets are similar enough."""
    hashes, name, first = WordHashes(), None, None
    for part in parts:
        keep = []
        for a, x, y in zip(part.column(0).to_pylist(), part.column(2), part.column(3)):
            if a != name:
                name, first = a, _unpacked(x.as_py(), hashes, like.shingle)
            second = _unpacked(y.as_py(), hashes, like.shingle)
            shared = len(np.intersect1d(first, second, assume_unique=True))
            keep.append(100 * shared >= like.percent * (len(first) + len(second) - shared))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _exploded(like: Likeness, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for part in parts:
        for sid, packed in zip(part.column(0).to_pylist(), part.column(1)):
            own = _unpacked(packed.as_py(), hashes, like.shingle)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.view(np.int64)), pa.array(np.full(len(own), sid, np.int64))], ["shingle", "sid"]
            )


def _shared(n: str, m: str, percent: int) -> str:
    """How much sets of n and m shingles share at least if they are linked, in SQL."""
    return f"ceil(({n} + {m}) * {percent} / {100 + percent})"


class NearDuplicates:
    """The steps of one run; every step's table is in ``scratch``.

    Documents with equal sets are one set from the start. Sets whose signatures agree in a chunk but for one
    symbol share a key. A key may be shared by a third of all sets, so its sets are not paired with each
    other: each is first held against one pivot, the set that shares most keys with others. Confirmed links
    join sets into components. Only keys that still hold sets of several components go on. There, sets are
    looked up by their rarest shingles: two that share as much as a link needs have one of them in common
    while enough of both is left. Copies with too many changes of their own end there, and shingles under
    which only one component is left are dropped, before sets of different components are paired. So no pair
    that shares a key and is similar enough is left out, and a group of near copies costs no square of its
    size.
    """

    def __init__(self, docs: DataFrame, scratch: Scratch, like: Likeness) -> None:
        self.scratch, self.like = scratch, like
        text = F.coalesce(F.col("text"), F.lit(""))
        self.rows = docs.select(id_key().alias("id"), F.xxhash64(text).alias("copy"), text.alias("text"))
        self.docs = scratch.keep(
            self.rows.mapInArrow(
                partial(_fingerprints, like), "id long, copy long, set binary, n long, signature binary"
            ),
            "docs",
        )
        self.sets = scratch.keep(
            self.docs.where("n > 0")
            .groupBy("set")
            .agg(
                F.min(F.struct("id", "copy")).alias("doc"),
                F.first("n").alias("n"),
                F.first("signature").alias("signature"),
            )
            .select(F.monotonically_increasing_id().alias("sid"), "set", "doc.id", "doc.copy", "n", "signature"),
            "sets",
        )

    def _verified(self, pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
        """Of pairs (a, b) those that are links."""
        side = lambda s, c: self.sets.select(F.col("sid").alias(s), F.col("signature").alias(c))
        body = lambda s, c: texts.select(F.col("sid").alias(s), F.col("packed").alias(c))
        close = self.scratch.keep(
            pairs.join(side("a", "x").hint("merge"), "a")
            .join(side("b", "y").hint("merge"), "b")
            .select("a", "b", "x", "y")
            .mapInArrow(partial(_close, self.like), "a long, b long"),
            f"{name}_close",
        )
        return self.scratch.keep(
            close.join(body("b", "y").hint("merge"), "b")
            .join(body("a", "x").hint("merge"), "a")
            .select("a", "b", "x", "y")
            .mapInArrow(partial(_linked, self.like), "a long, b long"),
            name,
        )

    def links(self) -> DataFrame:
        """Pairs (a, b) of connected sets, enough of them to connect all that are connected."""
        keys = self.sets.select("sid", "signature").mapInArrow(partial(_keys, self.like), "key long, sid long")
        shared = self.scratch.keep(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
        members = self.scratch.keep(keys.join(shared.hint("merge"), "key"), "members")
        of_sets = self.scratch.keep(members.groupBy("sid").agg(F.sum("size").alias("weight")), "weights")
        pivots = (
            members.join(of_sets.hint("merge"), "sid")
            .groupBy("key")
            .agg(F.max(F.struct("weight", "sid")).alias("pivot"))
            .select("key", F.col("pivot.sid").alias("a"))
        )
        pivots = self.scratch.keep(pivots, "pivots")
        tested = self.scratch.keep(
            members.join(pivots.hint("merge"), "key")
            .where("a != sid")
            .select("a", F.col("sid").alias("b"))
            .distinct(),
            "tested",
        )
        chosen = of_sets.select("sid").join(self.sets.select("sid", "id", "copy").hint("merge"), "sid")
        texts = self.scratch.keep(
            self.rows.join(chosen.hint("merge"), ["id", "copy"])
            .select("sid", "text")
            .mapInArrow(_packed, "sid long, packed binary"),
            "texts",
        )
        roots = components(self._verified(tested, texts, "links1"), self.scratch, "first")
        crossing = self._verified(self._crossing(members, roots, texts), texts, "links2")
        return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(crossing)

    def _crossing(self, members: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
        """Pairs of sets that share a key, are in different components and may be similar enough."""
        placed = members.select("key", "sid").join(
            roots.withColumnRenamed("node", "sid").hint("merge"), "sid", "left"
        ).select("key", "sid", F.coalesce("root", "sid").alias("root"))
        placed = self.scratch.keep(placed, "placed")
        several = self.scratch.keep(
            placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key"),
            "several",
        )
        placed = self.scratch.keep(placed.join(several.hint("merge"), "key"), "open")
        active = self.scratch.keep(
            placed.groupBy("sid")
            .agg(F.first("root").alias("root"))
            .join(self.sets.select("sid", "n").hint("merge"), "sid"),
            "active",
        )
        tokens = self.scratch.keep(
            texts.join(active.select("sid").hint("merge"), "sid").mapInArrow(
                partial(_exploded, self.like), "shingle long, sid long"
            ),
            "tokens",
        )
        common = tokens.groupBy("shingle").agg(F.count("*").alias("in_sets")).where("in_sets > 1")
        # Rare shingles first: those of one set alone, whose number is all that matters, then the others.
        of_set = Window.partitionBy("sid")
        place = F.row_number().over(of_set.orderBy("in_sets", "shingle")) - 1 - F.count("*").over(of_set)
        ranked = (
            tokens.join(common.hint("merge"), "shingle")
            .withColumn("from_end", place)
            .join(active.hint("merge"), "sid")
            # What two sets share from here on is at most what is left of each.
            .withColumn("left", -F.col("from_end"))
            .where(F.col("left") >= F.expr(f"ceil(n * {self.like.percent} / 100)"))
            .select("shingle", "sid", "root", "n", "left")
        )
        postings = self.scratch.keep(ranked, "postings")
        for round_ in (1, 2):
            postings = self.scratch.keep(self._hopeful(postings), f"hopeful{round_}")
        one = postings.select("shingle", *(F.col(c).alias(f"a_{c}") for c in ("sid", "root", "n", "left")))
        two = postings.select("shingle", *(F.col(c).alias(f"b_{c}") for c in ("sid", "root", "n", "left")))
        possible = F.expr(f"a_root < b_root AND least(a_left, b_left) >= {_shared('a_n', 'b_n', self.like.percent)}")
        return (
            one.join(two.hint("merge"), "shingle")
            .where(possible)
            .select(F.col("a_sid").alias("a"), F.col("b_sid").alias("b"))
            .distinct()
        )

    def _hopeful(self, postings: DataFrame) -> DataFrame:
        """Sets under a shingle that may be linked with a set of another component there."""
        others = (
            postings.groupBy("shingle")
            .agg(F.min("n").alias("least"), F.min("root").alias("lo"), F.max("root").alias("hi"))
            .where("lo != hi")
            .select("shingle", "least")
        )
        partner = f"greatest(least, cast(ceil(n * {self.like.percent} / 100) AS long))"
        enough = F.expr(f"`left` >= {_shared('n', partner, self.like.percent)}")
        return postings.join(others.hint("merge"), "shingle").where(enough).drop("least")

    def classes(self) -> DataFrame:
        """doc_id, n_shingles, component_id and kept of every document."""
        roots = components(self.links(), self.scratch, "last")
        named = self.sets.select("set", "sid", "id").join(
            roots.withColumnRenamed("node", "sid").hint("merge"), "sid", "left"
        ).select("set", "id", F.coalesce("root", "sid").alias("root"))
        named = self.scratch.keep(named, "named")
        smallest = named.groupBy("root").agg(F.min("id").alias("component"))
        of_set = self.scratch.keep(
            named.select("set", "root").join(smallest.hint("merge"), "root").select("set", "component"), "of_set"
        )
        return self.docs.join(of_set.hint("merge"), "set", "left").select(
            "id", "copy", "n", F.coalesce("component", "id").alias("component")
        )


def near_duplicates(docs: DataFrame, scratch: Scratch, like: Likeness = QUERY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Sets of lower-case (A-Z) shingles of whole texts, by default of three words; links by default at 85 % of
    the union, confirmed on whole sets; components by smallest id. NULL text and text without words have an
    empty set and are linked with nothing. NULL ids sort first. Repeated rows are one set; each has its row. An empty table gives none.
    """
    return NearDuplicates(docs, scratch, like).classes().select(
        id_of("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        id_of("component").alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"),
    )


def keep_one(docs: DataFrame, scratch: Scratch, like: Likeness = QUERY) -> DataFrame:
    """The documents with one of each component, that with the smallest id, and all their columns."""
    found = NearDuplicates(docs, scratch, like).classes()
    first = found.groupBy("component").agg(F.min(F.struct("id", "copy")).alias("first"))
    gone = found.join(first.hint("merge"), "component").where(
        (F.col("n") > 0) & (F.struct("id", "copy") != F.col("first"))
    )
    gone = scratch.keep(gone.select("id", "copy").distinct(), "gone")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), id_key().alias("id"), F.xxhash64(text).alias("copy"))
    return rows.join(gone.hint("merge"), ["id", "copy"], "left_anti").select("row.*")
