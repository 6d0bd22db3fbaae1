"""Line deduplication: hashes in range partitions, first occurrences streamed, keep bitmaps out."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlake.llm.common import Scratch, batches, id_key, id_of

LINE = pa.schema(
    [("hash", pa.binary()), ("id", pa.int64()), ("copy", pa.int64()), ("at", pa.int32()), ("lines", pa.int32())]
)
LINE_DDL = "hash binary, id long, copy long, at int, lines int"

#: What the streaming pass says of a row: its line goes, it is for the neighbours to decide, or it sums up
#: a run that touches the partition's edge (``at`` is then the number of documents, ``copy`` the last one).
DROPPED, UNDECIDED, EDGE = 0, 1, 2
MARK = pa.schema([("kind", pa.int8()), *LINE])
MARK_DDL = f"kind tinyint, {LINE_DDL}"

def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return line.strip().lower()


def line_hashes(min_chars: int):
    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in parts:
                for doc, copy, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                    lines = text.encode().split(b"\n")
                    for at, line in enumerate(lines):
                        key = line_key(line)
                        if len(key) >= min_chars and len(key.decode()) >= min_chars:
                            yield hashlib.blake2b(key, digest_size=16).digest(), doc, copy, at, len(lines)

        yield from batches(rows(), LINE)

    return hashed


def stream_runs(min_docs: int):
    """Decide the lines of one partition, sorted by hash, falling document, position.

    A run is the rows of one hash. Its first document keeps its lines, those of the others go once the run
    has ``min_docs`` documents; until then the few rows since the first document wait. The partition's first
    run may have begun, and its last may go on, in a neighbour: they leave rows undecided and sum up their
    documents.
    """

    def decide(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            hash_, first_run, docs, first, last, waiting = None, True, 0, None, None, []
            for part in parts:
                for row in zip(*(part.column(i).to_pylist() for i in range(5))):
                    if row[0] != hash_:
                        if first_run and hash_ is not None:
                            yield EDGE, hash_, first, last, docs, 0
                            first_run = False
                        hash_, docs, first, last, waiting = row[0], 0, row[1], None, []
                    if row[1] != last:
                        docs, last = docs + 1, row[1]
                    if first_run:
                        yield UNDECIDED, *row
                    elif docs >= min_docs:
                        yield from ((DROPPED, *r) for r in waiting)
                        waiting = []
                        yield DROPPED, *row
                    elif docs > 1:
                        waiting.append(row)
            if hash_ is not None:
                yield from ((UNDECIDED, *r) for r in waiting)
                yield EDGE, hash_, first, last, docs, 0

        yield from batches(rows(), MARK)

    return decide


def dropped_lines(docs: DataFrame, scratch: Scratch, min_chars: int, min_docs: int) -> DataFrame:
    """(id, copy, at, lines) of every line to drop; docs has id, copy and text without NULL."""
    lines = scratch.keep(docs.select("id", "copy", "text").mapInArrow(line_hashes(min_chars), LINE_DDL), "lines")
    order = [F.col("hash"), F.col("id").desc(), F.col("copy"), F.col("at")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = scratch.keep(
        lines.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(stream_runs(min_docs), MARK_DDL)
        .withColumn("part", F.spark_partition_id()),
        "marks",
    )
    # A hash that touches edges: its parts in order, a document on both sides of an edge counted once.
    edges = (
        marks.where(F.col("kind") == EDGE)
        .groupBy("hash")
        .agg(F.sort_array(F.collect_list(F.struct("part", "id", "copy", "at"))).alias("runs"))
        .select(
            "hash",
            F.col("runs")[0]["id"].alias("top"),
            F.expr(
                "aggregate(runs, 0, (n, r) -> n + r.at) - size(filter(runs, (r, i) -> i > 0 AND r.id = runs[i - 1].copy))"
            ).alias("docs"),
        )
        .where(F.col("docs") >= min_docs)
    )
    decided = marks.where(F.col("kind") == DROPPED).select("id", "copy", "at", "lines")
    on_edges = (
        marks.where(F.col("kind") == UNDECIDED)
        .join(F.broadcast(edges), "hash")  # two rows per partition at most
        .where(F.col("id") != F.col("top"))
        .select("id", "copy", "at", "lines")
    )
    return decided.unionByName(on_edges)


def keep_bitmap(dropped: list[int], lines: int) -> bytes:
    """One bit per line, set if it stays, compressed."""
    keep = np.ones(lines, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes())


def kept_flags(bitmap: bytes, lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=lines).astype(bool)


def _to_bitmaps(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        ids, copies, dropped, lines = (part.column(i) for i in range(4))
        maps = [keep_bitmap(d, n) for d, n in zip(dropped.to_pylist(), lines.to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [ids, copies, lines, pa.array(map(len, dropped.to_pylist()), pa.int64()), pa.array(maps, pa.binary())],
            ["id", "copy", "lines", "n_dropped", "bitmap"],
        )


def row_keys(docs: DataFrame) -> DataFrame:
    """id, copy (tells rows of one id apart by their text) and the text, none of them NULL."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(id_key().alias("id"), F.xxhash64(text).alias("copy"), text.alias("text"))


def keep_bitmaps(docs: DataFrame, scratch: Scratch, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Of every document that loses lines, the bitmap of those it keeps.

    Keys of ``min_chars`` code points or more in ``min_docs`` documents or more lose all their lines except
    in the document with the largest id. Lines become 128-bit hashes where the text is read. Range
    partitions by hash, document and position hold them in order, so a line of a third of all documents
    lies in many partitions; a run that crosses an edge is decided from two rows per partition.

    Returns id, copy, lines, n_dropped, bitmap (see ``row_keys``, ``kept_flags``). NULL text is empty and
    has one empty line; NULL ids count as one document below all others; rows with one id are one document.
    Documents that keep all lines have no row. An empty table gives an empty result.
    """
    return (
        dropped_lines(row_keys(docs), scratch, min_chars, min_docs)
        .distinct()  # a repeated row repeats its lines
        .groupBy("id", "copy")
        .agg(F.collect_list("at").alias("dropped"), F.first("lines").alias("lines"))
        .mapInArrow(_to_bitmaps, "id long, copy long, lines int, n_dropped long, bitmap binary")
    )


def _digests(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        texts, maps = part.column(1).to_pylist(), part.column(2).to_pylist()
        out = []
        for text, bitmap in zip(texts, maps):
            lines = text.split("\n")
            kept = lines if bitmap is None else [x for x, k in zip(lines, kept_flags(bitmap, len(lines))) if k]
            out.append((len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [part.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string())))]
            if out
            else [part.column(0), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string())],
            ["id", "n_lines", "n_dropped", "kept_sha256"],
        )


def kept_digests(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of the text that stays, of every document."""
    return (
        row_keys(docs)
        .join(bitmaps.select("id", "copy", "bitmap").hint("merge"), ["id", "copy"], "left")
        .select("id", "text", "bitmap")
        .mapInArrow(_digests, "id long, n_lines long, n_dropped long, kept_sha256 string")
        .select(id_of("id").alias("doc_id"), "n_lines", "n_dropped", "kept_sha256")
    )
