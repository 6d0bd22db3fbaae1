"""Secret scans behind an inverted index of trigrams, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlake.llm.common import Scratch, id_key, id_of
from bazaarlake.llm.trigrams import Query, trigram_query


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, and how long the match, or a group of it, has to be."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


#: The base kinds, in the order that breaks ties. Runs of one class are matched whole, so
#: {16,} finds what + and a test of the length find.
BASE = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        12,
        2,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
#: Further kinds, by the published forms of such tokens.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = (*BASE, *MORE)
#: Lengths that are added up in one fold.
BLOCK = 64


def holds(query: Query, has: Column) -> Column:
    """Whether the trigrams of a document satisfy a query."""
    found = F.lit(True)
    for term in sorted(query.terms):
        found = found & F.array_contains(has, term)
    for group in query.choices:
        one = F.lit(False)
        for choice in group:
            one = one | holds(choice, has)
        found = found & one
    return found


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(term, id, copy) for every term that a document contains in lower case."""
    contained = [F.when(F.col("low").contains(t), F.lit(t)) for t in terms]
    return (
        docs.select("id", "copy", F.lower("text").alias("low"))
        .select("id", "copy", F.array_compact(F.array(*contained)).alias("terms"))
        .select(F.explode("terms").alias("term"), "id", "copy")
    )


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """id, copy and the kinds whose query the document's postings satisfy.

    Postings meet by document, with partial sums first; a term that a third of all documents contain is no
    group of its own anywhere.
    """
    met = index.groupBy("id", "copy").agg(F.collect_set("term").alias("has"))
    kinds = F.array_compact(F.array(*(F.when(holds(q, F.col("has")), F.lit(k)) for k, q in queries.items())))
    return met.select("id", "copy", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running(lengths: Column, levels: int = 2) -> Column:
    """For each of the lengths the sum of those before it.

    A fold that appends to its result copies it at each step. So lengths are cut into blocks: the sums of the
    blocks are added up in the same way, and a fold appends within one block only.
    """
    if levels == 0:
        return F.aggregate(
            lengths,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("before")),
            lambda acc, x: F.struct(
                (acc["at"] + x).alias("at"), F.concat(acc["before"], F.array(acc["at"])).alias("before")
            ),
            lambda acc: acc["before"],
        )

    def blockwise(all_: Column) -> Column:
        firsts = F.when(F.size(all_) > 0, F.sequence(F.lit(1), F.size(all_), F.lit(BLOCK))).otherwise(
            F.array().cast("array<int>")
        )
        blocks = F.transform(firsts, lambda first: F.slice(all_, first, BLOCK))
        return _with(blocks, over)

    def over(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda acc, x: acc + x))
        return F.flatten(
            F.zip_with(
                blocks,
                running(sums, levels - 1),
                lambda block, start: F.transform(running(block, 0), lambda before: start + before),
            )
        )

    return _with(lengths, blockwise)


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """The matches of a rule in code points, as array of (start, rank, stop, kind).

    The text between the matches and the matches alternate, so their lengths add up to the places.
    """
    pattern = F.lit(rule.pattern)
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    tested = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)

    def placed(steps: Column) -> Column:
        widths = F.transform(steps, lambda x: x["gap"] + F.coalesce(x["long"], F.lit(0)))
        places = F.zip_with(
            steps,
            running(widths),
            lambda x, at: F.struct(
                (at + x["gap"]).alias("start"), (at + x["gap"] + x["long"]).alias("stop"), x["test"].alias("test")
            ),
        )
        return F.transform(
            F.filter(places, lambda x: x["test"] >= rule.least),
            lambda x: F.struct(
                x["start"].alias("start"),
                F.lit(rank).alias("rank"),
                x["stop"].alias("stop"),
                F.lit(rule.kind).alias("kind"),
            ),
        )

    return _with(F.arrays_zip(between.alias("gap"), whole.alias("long"), tested.alias("test")), placed)


def scan(docs: DataFrame, scratch: Scratch, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every document with the secrets found: doc_id, found (array of start, rank, stop, kind, by place).

    Each rule's pattern gives a Boolean query of trigrams that its matches must contain. The trigrams of all
    queries are looked up in each text once; their postings are written, intersected per document, and only
    candidates are verified with the pattern. A rule whose pattern has no mandatory trigram (a run of hex
    digits) is tried on every document.

    Whole texts are scanned, in time that grows with their length and their matches. NULL text is empty and has no secrets; NULL ids and repeated rows keep a row
    each; an empty table gives none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(id_key().alias("id"), F.xxhash64(text).alias("copy"), text.alias("text"))
    queries = {r.kind: q for r in rules if not (q := trigram_query(r.pattern)).empty}
    terms = sorted(set().union(*(q.trigrams() for q in queries.values())))
    index = scratch.keep(postings(rows, terms), "postings")
    chosen = scratch.keep(candidates(index, queries), "candidates")
    met = rows.join(chosen.hint("merge"), ["id", "copy"], "left")
    none = F.array().cast("array<struct<start:int,rank:int,stop:int,kind:string>>")
    found = [
        F.when(
            (F.array_contains("kinds", r.kind) if r.kind in queries else F.lit(True)) & F.col("text").rlike(r.pattern),
            spans(F.col("text"), r, rank),
        ).otherwise(none)
        for rank, r in enumerate(rules)
    ]
    return met.select(id_of("id").alias("doc_id"), F.array_sort(F.concat(*found)).alias("found"))


def as_text(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def report(scanned: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of their spans and all spans as text."""
    base = len(BASE)
    of = lambda rank: F.size(F.filter("found", lambda s: s["rank"] == rank)).cast("long")
    return scanned.select(
        "doc_id",
        *(of(rank).alias(f"n_{r.kind}") for rank, r in enumerate(BASE)),
        F.sha2(as_text(F.filter("found", lambda s: s["rank"] < base)).cast("binary"), 256).alias("base_sha256"),
        as_text(F.col("found")).alias("spans"),
    )
