"""Quality rules as a ledger: every rule once per document, policies and ablations by bits afterwards."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlake.llm.common import id_key, id_of

#: Words in a window, and words that are worked on at once.
WINDOW, AT_ONCE = 8, 1_000_000
#: What counts as a symbol, and the characters between words.
SYMBOLS, SPACES = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"), " \t\n\x0b\x0c\r"

MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_lines",
    "n_dup_lines",
    "n_repeat_words",
    "n_stutter_words",
    "n_upper",
    "n_lower",
)

#: A document fails a rule if its condition holds, on columns as on arrays; the place in the list is the bit.
RULES = {
    "few_words": lambda m: m["n_words"] < 20,
    "repeated_words": lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"],
    "symbols": lambda m: 10 * m["n_symbols"] > 3 * m["n_words"],
    "repeated_lines": lambda m: 2 * m["n_dup_lines"] > m["n_lines"],
    "stutter": lambda m: 2 * m["n_stutter_words"] > m["n_words"],
    "shouting": lambda m: m["n_upper"] > m["n_lower"],
}


@dataclass(frozen=True)
class Policy:
    """The rules that reject a document, under a version that is never changed."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_words"))
STRICT = Policy("strict-1", tuple(RULES))


class Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _ranks(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1]


def repeated_words(words: np.ndarray, docs: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document the words in windows that occur twice or more in it; words and documents are numbers.

    Windows are compared exactly, by ranks of 2, 4 and 8 words, where a hash of the window occurs twice.
    """
    none = np.zeros(n_docs, np.int64)
    n = len(words) - WINDOW + 1
    if n < 2:
        return none
    hashed = docs[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(WINDOW):
        hashed = hashed * np.uint64(0x100000001B3) + words[k : n + k].astype(np.uint64)
    whole = np.flatnonzero(docs[:n] == docs[WINDOW - 1 :])
    order = whole[np.argsort(hashed[whole], kind="stable")]
    suspects = np.zeros(n_docs, bool)
    suspects[docs[order[1:][hashed[order[1:]] == hashed[order[:-1]]]]] = True
    own = suspects[docs]
    words, docs = words[own], docs[own]
    n = len(words) - WINDOW + 1
    if n < 2:
        return none
    rank = _ranks(docs * (words.max() + 1) + words)
    for step in (1, 2, 4):
        rank = _ranks(rank[:-step] * (rank.max() + 1) + rank[step:])
    whole = docs[:n] == docs[WINDOW - 1 :]
    counts = np.bincount(rank[whole])
    starts = np.flatnonzero(whole)[counts[rank[whole]] > 1]
    edges = np.bincount(starts, minlength=len(words) + 1) - np.bincount(starts + WINDOW, minlength=len(words) + 1)
    covered = np.cumsum(edges)[:-1] > 0
    return np.bincount(docs[covered], minlength=n_docs)


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """The measurements of every text."""
    numbers, words, rows = Numbers(), [np.zeros(0, np.int64)], []
    for text in texts:
        coded = text.encode()
        own = coded.split()
        lines = [x for x in coded.split(b"\n") if x.strip()]
        letters = np.frombuffer(coded, np.uint8)
        rows.append(
            (
                len(own),
                len(text) - sum(map(text.count, SPACES)),
                sum(map(coded.count, SYMBOLS)),
                len(lines),
                len(lines) - len(set(lines)),
                np.count_nonzero((letters >= 65) & (letters <= 90)),
                np.count_nonzero((letters >= 97) & (letters <= 122)),
            )
        )
        words.append(np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)))
    n_words, word_chars, n_symbols, n_lines, n_dup, n_upper, n_lower = np.array(rows, np.int64).reshape(-1, 7).T
    stream = np.concatenate(words)
    docs = np.repeat(np.arange(len(texts)), n_words)
    again = (stream[1:] == stream[:-1]) & (docs[1:] == docs[:-1])
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": n_symbols,
        "n_lines": n_lines,
        "n_dup_lines": n_dup,
        "n_repeat_words": repeated_words(stream, docs, len(texts)),
        "n_stutter_words": np.bincount(docs[1:][again], minlength=len(texts)),
        "n_upper": n_upper,
        "n_lower": n_lower,
    }


def portions(part: pa.RecordBatch, text_at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with their texts, each of bounded size; NULL is empty."""
    texts, start, held = [], 0, 0
    for at, text in enumerate(part.column(text_at)):
        texts.append(text.as_py() or "")
        held += len(texts[-1])
        if held > 4 * AT_ONCE:
            yield part.slice(start, at + 1 - start), texts
            texts, start, held = [], at + 1, 0
    if texts:
        yield part.slice(start), texts


def _measured(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for rows, texts in portions(part, 1):
            found = measure(texts)
            columns = [rows.column(0), *(pa.array(found[m], pa.int64()) for m in MEASURES)]
            yield pa.RecordBatch.from_arrays(columns, ["id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """id, the MEASURES and ``failures``, the bits of the RULES that a document fails. One scan, no shuffle.

    NULL text has no words. Rows that repeat and NULL ids keep a row each. An empty table gives none.
    """
    measured = docs.select(id_key().alias("id"), "text").mapInArrow(
        _measured, "id long, " + ", ".join(f"{m} long" for m in MEASURES)
    )
    columns = {m: F.col(m) for m in MEASURES}
    failures = F.lit(0)
    for bit, rule in enumerate(RULES.values()):
        failures = failures.bitwiseOR(F.when(rule(columns), F.lit(1 << bit)).otherwise(F.lit(0)))
    return measured.withColumn("failures", failures)


def rejects(policy: Policy) -> Column:
    """Whether the policy rejects a row of the ledger."""
    return F.col("failures").bitwiseAND(F.lit(policy.mask)) != 0


def ablation(ledger_: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: documents that fail it (n_failed), and that only it rejects (n_only_this).

    Failures are counted per bit pattern, of which there are no more than two to the power of the rules.
    """
    patterns = (
        ledger_.select(F.col("failures").bitwiseAND(F.lit(policy.mask)).alias("bits"))
        .groupBy("bits")
        .agg(F.count("*").alias("n"))
    )
    names = list(RULES)
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).alias("bit")) for r in policy.rules))
    alone = F.when(F.col("bits") == F.col("one.bit"), F.col("n")).otherwise(F.lit(0))
    failed = F.when(F.col("bits").bitwiseAND(F.col("one.bit")) != 0, F.col("n")).otherwise(F.lit(0))
    return (
        patterns.withColumn("one", F.explode(rules))
        .groupBy("one.rule")
        .agg(F.sum(failed).alias("n_failed"), F.sum(alone).alias("n_only_this"))
    )


def verdicts(ledger_: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """The ledger with doc_id, base_failed and kept under a policy."""
    return ledger_.select(
        id_of("id").alias("doc_id"),
        *MEASURES,
        "failures",
        rejects(BASE).alias("base_failed"),
        (~rejects(BASE) & ~rejects(policy)).alias("kept"),
    )


def keep_good(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """The documents that a policy keeps, with all their columns.

    Rows are measured and filtered where they are read, so nothing is joined.
    """
    text_at = docs.columns.index("text")
    rules = [rule for name, rule in RULES.items() if name in (*BASE.rules, *policy.rules)]

    def judged(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rows, texts in portions(part, text_at):
                found = measure(texts)
                bad = np.zeros(len(texts), bool)
                for rule in rules:
                    bad |= rule(found)
                yield rows.filter(pa.array(~bad))

    return docs.mapInArrow(judged, docs.schema)
