"""Ranked lexical search: an index of compressed blocks in shards, searched by block-max MaxScore."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarlake.llm.common import Scratch, id_key, id_of

#: Postings in a block, terms in a shard (a longer document is a shard of its own), queries in a block of them.
BLOCK, SHARD, QUERIES = 128, 4_000_000, 256
#: Bytes of a text that are split at once.
AT_ONCE = 4_000_000

#: Terms are runs of 0-9, A-Z, a-z and everything from 0x80 up; A-Z are lower-cased.
LOWERED = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


class Numbers(dict):
    """Numbers terms as they come."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded slice of it at a time; of NULL none."""
    data = (text or "").encode().translate(LOWERED)
    at = 0
    while at < len(data):
        cut = data.find(b" ", at + AT_ONCE)
        cut = len(data) if cut < 0 else cut
        yield data[at:cut].split()
        at = cut


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term's weight is multiplied with; grows with tf, falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def length_norms(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents by their terms; Python's integers, as the product outgrows a word on a large corpus."""
    return np.array([10 + 90 * n * n_docs // n_terms for n in lengths.tolist()], np.int64)


# -- blocks -----------------------------------------------------------------------------------------------


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in groups of seven bits, and where each number's bytes end."""
    sizes = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in range(1, 6))
    ends = np.cumsum(sizes)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(sizes.max(initial=0)):
        has = np.flatnonzero(sizes > k)
        more = (sizes[has] > k + 1).astype(np.int64) << 7
        out[(ends - sizes)[has] + k] = (values[has] >> 7 * k) & 127 | more
    return out, ends


def numbers_of(raw: np.ndarray) -> np.ndarray:
    """What ``varints`` was given."""
    last = np.flatnonzero(raw < 128)
    first = np.r_[0, last[:-1] + 1]
    shift = 7 * (np.arange(len(raw)) - np.repeat(first, last - first + 1))
    return np.add.reduceat((raw & 127).astype(np.int64) << shift, first)


def competitive(block: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The postings of each block whose (tf, length) no other of the block beats in both, as ascending places.

    Whatever the corpus statistics turn out to be, a block's largest impact is one of theirs.
    """
    order = np.lexsort((length, -tf, block))
    # Lengths are lowered from block to block, so that a running minimum starts anew with each.
    lowered = length[order] - block[order] * (length.max(initial=0) + 1)
    least = np.minimum.accumulate(lowered)
    return np.sort(order[np.r_[True, least[1:] < least[:-1]]]) if len(order) else order


INDEX_DDL = "shard long, term binary, df long, total long, postings binary, skips binary"
INDEX = pa.schema(
    [("shard", pa.int64()), ("term", pa.binary()), ("df", pa.int64()), ("total", pa.int64())]
    + [("postings", pa.binary()), ("skips", pa.binary())]
)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of bytes that lie one after another."""
    offsets = np.r_[0, ends].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def shard_rows(shard: int, ids: list[int], numbered: list[np.ndarray], numbers: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """One shard: a row of its documents (term NULL), then a row per term in the order of terms.

    postings: per document the distance from the one before it in the block and tf - 1. skips: rows of four
    numbers for each competitive posting: last document and end byte of its block, tf, length.
    """
    lengths = np.array([len(x) for x in numbered], np.int64)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(x, f.type)
            for x, f in zip(
                (
                    [shard],
                    [None],
                    [int(np.count_nonzero(lengths))],
                    [int(lengths.sum())],
                    [np.array(ids, np.int64).tobytes()],
                    [lengths.tobytes()],
                ),
                INDEX,
            )
        ],
        schema=INDEX,
    )
    if not numbers:
        return
    names = sorted(numbers)
    place = np.empty(len(names), np.int64)
    place[[numbers[t] for t in names]] = np.arange(len(names))
    pairs = place[np.concatenate(numbered)] * len(ids) + np.repeat(np.arange(len(ids)), lengths)
    pairs, tf = np.unique(pairs, return_counts=True)
    term, doc = np.divmod(pairs, len(ids))
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    df = np.diff(np.r_[first, len(term)])
    begins = (np.arange(len(term)) - first[term]) % BLOCK == 0
    block = np.cumsum(begins) - 1
    gaps = np.where(begins, doc, np.diff(doc, prepend=0))
    raw, ends = varints(np.column_stack([gaps, tf - 1]).ravel())
    ends = ends[1::2]  # after each posting
    last = np.r_[np.flatnonzero(begins)[1:], len(term)] - 1  # posting that ends a block
    best = competitive(block, tf, lengths[doc])
    start = np.r_[0, ends[first[1:] - 1]][term[best]]  # a term's first byte
    own = last[block[best]]
    skips = np.column_stack([doc[own], ends[own] - start, tf[best], lengths[doc[best]]])
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(names), shard)),
            pa.array(names, pa.binary()),
            pa.array(df),
            pa.array(np.add.reduceat(tf, first)),
            _binary(raw, ends[first + df - 1]),
            _binary(skips.astype(np.int64).view(np.uint8), 32 * np.cumsum(np.bincount(term[best]))),
        ],
        schema=INDEX,
    )


def _indexed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> Iterator[pa.RecordBatch]:
        for rows in shard_rows((TaskContext.get().partitionId() << 32) + shards, ids, numbered, numbers):
            yield from pa.Table.from_batches([rows]).to_batches(max_chunksize=50_000)

    ids, numbered, numbers, held, shards = [], [], Numbers(), 0, 0
    for part in parts:
        for id_, text in zip(part.column(0).to_pylist(), part.column(1)):
            own = [np.fromiter(map(numbers.__getitem__, x), np.int32, len(x)) for x in terms(text.as_py())]
            ids.append(id_)
            numbered.append(np.concatenate(own) if own else np.zeros(0, np.int32))
            held += len(numbered[-1])
            if held > SHARD:
                yield from out()
                ids, numbered, numbers, held, shards = [], [], Numbers(), 0, shards + 1
    if ids:
        yield from out()


def build_index(docs: DataFrame) -> DataFrame:
    """The index of every row of ``docs`` (doc_id, text), without a shuffle.

    Each task cuts what it reads into shards of bounded size. A shard has its terms in order, so that a
    stored index is skipped through by term, and knows nothing of the corpus: bounds are kept as pairs of
    tf and length, which any N and L turn into impacts. See ``shard_rows`` for the columns.

    NULL text has no terms, NULL ids are one id below all others, repeated rows are documents of their own.
    """
    return docs.select(id_key().alias("id"), "text").mapInArrow(_indexed, INDEX_DDL)


# -- search -----------------------------------------------------------------------------------------------


class List:
    """One term's postings in a shard; blocks are decompressed when they are needed, once."""

    def __init__(self, raw: bytes, skips: bytes, norms_by_length: dict[int, int], norms: np.ndarray, weight: int) -> None:
        self.raw, self.norms, self.weight = np.frombuffer(raw, np.uint8), norms, weight
        last, end, tf, length = np.frombuffer(skips, np.int64).reshape(-1, 4).T
        first = np.flatnonzero(np.r_[True, end[1:] != end[:-1]])
        m = np.array([norms_by_length[n] for n in length.tolist()], np.int64)
        self.last, self.ends = last[first], np.r_[0, end[first]]
        self.block_bounds = weight * np.maximum.reduceat(impact(tf, m), first)
        self.bound = int(self.block_bounds.max())
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block and what the term adds to their scores."""
        if b not in self.open:
            values = numbers_of(self.raw[self.ends[b] : self.ends[b + 1]])
            found = np.cumsum(values[::2])
            self.open[b] = found, self.weight * impact(values[1::2] + 1, self.norms[found])
        return self.open[b]


def best(lists: list[List], n_docs: int, k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k documents with the largest scores above 0, and the scores; ties by id.

    Lists ascend by their bounds; ``below[i]`` is what the first i can add at most. Beginning with the
    largest bound, lists are essential until all that is left stays below the threshold, the k-th largest
    score so far: a document in none of them can't get there. Of essential lists, blocks are passed over
    whose bound with what is known of their documents stays below it. The other lists are then asked for the
    documents that remain, and a document leaves by the bound of the block in which it would be before that
    block is decompressed. Documents leave only if they are below the threshold, never if they equal it.
    """
    lists = sorted(lists, key=lambda x: x.bound)
    below = np.cumsum([0, *(x.bound for x in lists)])
    score = np.zeros(n_docs, np.int64)
    threshold, i = 1, len(lists)

    def raised(scores: np.ndarray) -> int:
        return max(threshold, int(np.partition(scores, len(scores) - k)[len(scores) - k])) if len(scores) >= k else threshold

    while i and below[i] >= threshold:
        i -= 1
        own = lists[i]
        known = np.maximum.reduceat(score, np.r_[0, own.last[:-1] + 1])
        for b in np.flatnonzero(known + own.block_bounds + below[i] >= threshold):
            found, added = own.block(b)
            score[found] += added
        threshold = raised(score)
    left = np.flatnonzero((score > 0) & (score + below[i] >= threshold))
    for j in range(i - 1, -1, -1):
        own = lists[j]
        at = np.searchsorted(own.last, left)
        bounds = np.r_[own.block_bounds, 0][at]
        stay = score[left] + bounds + below[j] >= threshold
        left, at = left[stay], at[stay]
        for b in np.unique(at[at < len(own.last)]):
            found, added = own.block(b)
            score[found] += added
        threshold = raised(score[left])
        left = left[score[left] + below[j] >= threshold]
    order = np.lexsort((ids[left], -score[left]))[:k]
    return left[order], score[left][order]


FOUND_DDL = "q long, shard long, id long, score long"
FOUND = pa.schema([(c, pa.int64()) for c in ("q", "shard", "id", "score")])


def _searcher(n_docs: int, n_terms: int, k: int):
    def search_shard(rows: pa.Table) -> pa.Table:
        held = rows.column("term").is_null()
        shard = rows.filter(held).to_pylist()[0]
        ids = np.frombuffer(shard["postings"], np.int64)
        lengths = np.frombuffer(shard["skips"], np.int64)
        sizes, which = np.unique(lengths, return_inverse=True)
        m = length_norms(sizes, n_docs, n_terms)
        by_length, norms = dict(zip(sizes.tolist(), m.tolist())), m[which]
        asked: dict[int, list[List]] = {}
        for row in rows.filter(pa.compute.invert(held)).to_pylist():
            own = List(row["postings"], row["skips"], by_length, norms, row["weight"])
            for q in row["queries"]:
                asked.setdefault(q, []).append(own)
        out = []
        for q, lists in asked.items():
            found, scores = best(lists, len(ids), k, ids)
            out += [(q, shard["shard"], int(ids[d]), int(s)) for d, s in zip(found, scores)]
        columns = zip(*out) if out else [[]] * 4
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=FOUND)

    return search_shard


def _asked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        rows = [
            (q, t)
            for q, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist())
            for t in {t for some in terms(text) for t in some}
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["q", "term"]
        )


def ranked(index: DataFrame, items: DataFrame, scratch: Scratch, k: int = 10) -> DataFrame:
    """For each row of ``items`` (item_id, text) its k best documents: item_id, rank, doc_id, score.

    A score sums, over the distinct terms of the item, weight * (10**9 tf div (1000 tf + 8 m)) with
    weight = floor(1000 ln((2 N + 2) / (2 df + 1))) and m = 10 + 90 n N div L; only scores above 0 count and
    equal ones are in the order of doc_id. Every item meets every shard, items in blocks of QUERIES, so a
    task holds one shard and one block of queries; the shards' best are merged by a part of the shards first.

    NULL and empty items have no rows; repeated items have their rows each. An empty index gives none.
    """
    asked = scratch.keep(
        items.select(F.monotonically_increasing_id().alias("q"), F.col("item_id").alias("item"), "text"), "items"
    )
    blocks = max(1, -(-asked.count() // QUERIES))
    pairs = scratch.keep(asked.select("q", "text").mapInArrow(_asked, "q long, term binary"), "asked")
    size = index.where("term IS NULL").agg(F.sum("df").alias("docs"), F.sum("total").alias("terms")).first()
    n_docs, n_terms = size["docs"] or 0, size["terms"] or 0
    if not n_terms:
        return asked.limit(0).selectExpr("item AS item_id", "int(0) AS rank", "0L AS doc_id", "0L AS score")
    lists = scratch.keep(
        index.join(pairs.select("term").distinct(), "term", "left_semi").select("shard", "term", "df", "postings", "skips"),
        "lists",
    )
    weights = (
        lists.groupBy("term")
        .agg(F.sum("df").alias("df"))
        .select("term", F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).alias("weight"))
        .where("weight > 0")
    )
    by_block = (
        pairs.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)))
        .groupBy("term", "block")
        .agg(F.collect_list("q").alias("queries"))  # a block of queries
        .join(weights, "term")
    )
    columns = ["shard", "block", "term", "postings", "skips", "weight", "queries"]
    shards = index.where("term IS NULL").select(
        "*",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
        F.lit(0).cast("long").alias("weight"),
        F.array().cast("array<bigint>").alias("queries"),
    )
    found = scratch.keep(
        lists.join(by_block, "term")
        .select(columns)
        .unionByName(shards.select(columns))
        .groupBy("shard", "block")
        .applyInArrow(_searcher(n_docs, n_terms, k), FOUND_DDL),
        "found",
    )
    order = [F.desc("score"), F.asc("id")]
    parts = found.withColumn("part", F.pmod(F.xxhash64("shard"), F.lit(256)))
    some = parts.withColumn("rank", F.row_number().over(Window.partitionBy("q", "part").orderBy(*order)))
    every = some.where(F.col("rank") <= k).withColumn(
        "rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))
    )
    return (
        every.where(F.col("rank") <= k)
        .join(asked.select("q", "item"), "q")
        .select(F.col("item").alias("item_id"), "rank", id_of("id").alias("doc_id"), "score")
    )


def search(docs: DataFrame, items: DataFrame, scratch: Scratch, k: int = 10) -> DataFrame:
    """``ranked`` over an index that is built and stored first."""
    return ranked(scratch.keep(build_index(docs), "index"), items, scratch, k)
