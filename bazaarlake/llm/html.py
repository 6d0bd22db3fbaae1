"""Main text of web pages: page differencing between nearest URLs, on lines told apart by their markup."""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlake.llm.common import Scratch, batches, global_rank, id_key, id_of

# -- lines of one page ----------------------------------------------------------------------------------

#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is no text of the page, and those that stand around its main text.
NO_TEXT = frozenset("script style noscript template head title svg math iframe object canvas textarea select".split())
AROUND = frozenset("nav footer header aside form menu dialog button".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold the main text, and words of id, class or role that say the same.
MAIN = frozenset(("article", "main"))
#: Words of id, class or role that tell what stands around the main text.
AROUND_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices "
    "pagination popup promo promoted promotion related replies reply respond responses share sharing sidebar "
    "sidebars signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Of these, words of what readers or advertisers add, of wrappers and of articles themselves.
READERS = frozenset("comment comments disqus".split())
NO_ARTICLE = frozenset("ad ads advert adverts advertisement comment reply".split())
#: A name that begins so (has-sidebar, no-comments) tells what the page is like, not what the element is.
STATES = frozenset("has have no not with without".split())
#: A p ends where one of these begins.
ENDS_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot caption option legend summary".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(id|class|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}
WORDS = re.compile(r"[a-z]+")

#: What the markup says of a line: part of the main text, around it, or nothing.
CONTENT, BOILERPLATE, UNKNOWN = 1, 0, 2


#: What an element is: around the main text, whatever it holds; around it by a form or name that page wrappers
#: have too; or the main text.
AROUND_IT, PERHAPS, MAIN_TEXT = 1, 2, 3


def element(name: str, attributes: str, in_main: bool) -> int:
    """What an element is, 0 if nothing; a header or plain list inside a main text may be part of it."""
    said = 0
    if name in AROUND and not (in_main and name == "header"):
        if name != "form":
            return AROUND_IT
        said = PERHAPS
    article = name in MAIN
    if attributes and name not in ("html", "body"):
        for key, *values in ATTRIBUTE.findall(attributes):
            value = next((v for v in values if v), "").lower()
            if key.lower() in ("hidden", "aria-hidden"):
                if not article and (key.lower() == "hidden" or value == "true"):
                    return AROUND_IT
                continue
            if key.lower() == "role" and value == "main":
                article = True
            named = [WORDS.findall(v) for v in value.split()]
            words = {w for ws in named if ws and ws[0] not in STATES for w in ws}
            if name in MAIN:
                if NO_ARTICLE & words:
                    return AROUND_IT
            elif AROUND_WORDS & words and not (in_main and "header" in value):
                if READERS & words:
                    return AROUND_IT
                said = PERHAPS
    return said or (MAIN_TEXT if article else 0)


def verdicts(lines: list[tuple[str, tuple[int, ...]]], kinds: list[int]) -> list[tuple[str, int]]:
    """Lines with what the elements around them, by number in ``kinds``, say of them.

    Elements that are perhaps around the main text are wrappers of the page if they hold its largest main
    element, and that has more text than lies undecided outside; without a main element, if they hold more
    than half of the text.
    """
    sizes: dict[tuple[int, ...], int] = {}
    held: dict[int, int] = {}
    undecided = total = 0
    for text, inside in lines:
        said = [kinds[e] for e in inside]
        if AROUND_IT in said:
            continue
        total += len(text)
        for e in inside:
            held[e] = held.get(e, 0) + len(text)
        if not said:
            undecided += len(text)
        elif said[-1] == MAIN_TEXT:
            sizes[inside] = sizes.get(inside, 0) + len(text)
    if sizes:
        largest = max(sizes, key=lambda inside: sizes[inside])
        wrappers = set(largest) if sizes[largest] > undecided else set()
    else:
        wrappers = {e for e, n in held.items() if 2 * n > total}

    def verdict(inside: tuple[int, ...]) -> int:
        said = {kinds[e] for e in inside if kinds[e] != PERHAPS or e not in wrappers}
        if said & {AROUND_IT, PERHAPS}:
            return BOILERPLATE
        return CONTENT if said else UNKNOWN

    return [(text, verdict(inside)) for text, inside in lines]


def page_lines(page: str) -> list[tuple[str, int]]:
    """The page's blocks as lines of decoded text, white space as one space, with what the markup says."""
    lines: list[tuple[str, tuple[int, ...]]] = []
    kinds: list[int] = []
    words: list[str] = []
    stack: list[tuple[str, int | None]] = []  # name, number in kinds

    def end_block() -> None:
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            lines.append((text, tuple(e for _, e in stack if e is not None)))

    def pop_to(at: int) -> None:
        end_block()
        del stack[at:]

    at = 0
    while True:
        token = TOKEN.search(page, at)
        plain = page[at : token.start() if token else len(page)]
        if plain and not any(n in NO_TEXT for n, _ in stack):
            words.append(html.unescape(plain))
        if token is None:
            break
        at = token.end()
        if token["name"] is None:
            if token[0].startswith("<![CDATA["):
                words.append(token[0][9:].removesuffix("]]>"))
            continue
        name = token["name"].lower()
        if token["close"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None and (name in BLOCKS or not any(n in BLOCKS for n, _ in stack[depth + 1 :])):
                if name in BLOCKS or stack[depth][1] is not None:
                    pop_to(depth)
                else:
                    del stack[depth:]
            elif name == "p":
                end_block()
            continue
        if name == "br":
            words.append(" ")
            continue
        if name in BLOCKS:
            if name in ENDS_P:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCKS), None)
                if depth is not None and stack[depth][0] == "p":
                    pop_to(depth)
            if name in ("li", "dt", "dd", "option", "tr", "td", "th"):
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCKS), None)
                if depth is not None and stack[depth][0] == name:
                    pop_to(depth)
            end_block()
        if name in VOID or token["rest"].rstrip().endswith("/"):
            continue
        in_main = any(e is not None and kinds[e] == MAIN_TEXT for _, e in stack)
        kind = element(name, token["rest"], in_main)
        if kind and name not in BLOCKS:
            end_block()
        if name in RAW:
            close = RAW[name].search(page, at)
            at = close.end() if close else len(page)
            continue
        if kind:
            kinds.append(kind)
        stack.append((name, len(kinds) - 1 if kind else None))
    end_block()
    return verdicts(lines, kinds)


# -- differences between pages --------------------------------------------------------------------------


def line_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def aligned(x: list[int], y: list[int]) -> Iterator[int]:
    """Places in x on a longest common subsequence with y, from the last to the first.

    A row of the table of lengths is a number with a bit for each step from one length to the next. Rows are
    kept at every root of their number, and those between are made again on the way back, so memory grows
    with the lines times that root, in bits.
    """
    full, at = (1 << len(y)) - 1, defaultdict(list)
    for j, q in enumerate(y):
        at[q].append(j)

    @lru_cache(256)
    def mask(p: int) -> int:
        bits = bytearray(len(y) // 8 + 1)
        for j in at[p]:
            bits[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(bits, "little")

    def below(row: int, p: int) -> int:
        # Bits that are not set are steps.
        hit = row & mask(p)
        return ((row + hit) | (row - hit)) & full

    every = isqrt(len(x)) + 1
    kept, row = [full], full
    for i, p in enumerate(x, 1):
        row = below(row, p)
        if i % every == 0:
            kept.append(row)
    rows: list[int] = []
    first = len(x) + 1  # number of the first of rows

    def lengths(i: int) -> int:
        nonlocal rows, first
        if i < first:
            first = i // every * every
            rows = [kept[first // every]]
            for p in x[first : min(first + every, len(x) + 1) - 1]:
                rows.append(below(rows[-1], p))
        return rows[i - first] ^ full

    i, j = len(x), len(y)
    here = lengths(i)
    length = here.bit_count()
    while i and j:
        above = lengths(i - 1)
        over = (above & ((1 << j) - 1)).bit_count()
        while j and x[i - 1] != y[j - 1] and over < length:
            j -= 1
            length -= here >> j & 1
            over -= above >> j & 1
        if not j:
            return
        i -= 1
        if x[i] == y[j - 1]:
            yield i
            j -= 1
            over -= above >> j & 1
        here, length = above, over


def shared_lines(own: list[int], other: list[int]) -> set[int]:
    """Places in ``own`` on a longest common subsequence with ``other``.

    Equal beginnings and ends belong to one; of the rest only lines that are on both sides can.
    """
    head = 0
    while head < min(len(own), len(other)) and own[head] == other[head]:
        head += 1
    tail = 0
    while tail < min(len(own), len(other)) - head and own[-1 - tail] == other[-1 - tail]:
        tail += 1
    common = set(range(head)) | set(range(len(own) - tail, len(own)))
    a = own[head : len(own) - tail]
    b = other[head : len(other) - tail]
    both = set(a) & set(b)
    places = [i for i, x in enumerate(a) if x in both]
    x, y = [a[i] for i in places], [z for z in b if z in both]
    if not x:
        return common
    common.update(head + places[i] for i in aligned(x, y))
    return common


LINES = pa.schema(
    [(c, pa.int64()) for c in ("id", "copy")]
    + [(c, pa.string()) for c in ("host", "path")]
    + [("hashes", pa.list_(pa.int64())), ("open", pa.bool_())]
)


def _hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for part in parts:
            *keys, pages = (part.column(i) for i in range(5))
            for *key, page in zip(*(k.to_pylist() for k in keys), pages):
                lines = page_lines(page.as_py())
                yield *key, [line_hash(t) for t, _ in lines], any(s == UNKNOWN for _, s in lines)

    yield from batches(rows(), LINES)


def _differences(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("host", pa.string()), ("digest", pa.string()), ("shared", pa.list_(pa.int32()))])

    def rows():
        for part in parts:
            for host, digest, own, other in zip(*(part.column(i).to_pylist() for i in range(4))):
                if shared := shared_lines(own, other):
                    yield host, digest, sorted(shared)

    yield from batches(rows(), schema)


def _texts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def rows():
        for part in parts:
            for id_, url, page, shared in zip(
                part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3).to_pylist()
            ):
                lines = page_lines(page.as_py())
                gone = set(shared or ())
                kept = [
                    t
                    for i, (t, said) in enumerate(lines)
                    if said == CONTENT or (said == UNKNOWN and i not in gone)
                ]
                text = "\n".join(kept)
                yield id_, url, text, len(text)

    yield from batches(rows(), schema)


HOST, PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def shared_with_nearest(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, copy, shared) of pages with lines that the markup leaves open: places of lines that their
    nearest page has too. pages has id, copy, host, path, html.

    Pages of a host with the same lines are one, as they tell nothing of each other. They are ranked by host
    and path, and each is held against the one before or after it whose path has more in common. Addresses
    and line hashes are ranked and joined, never whole pages.
    """
    hashed = scratch.keep(
        pages.mapInArrow(_hashed, "id long, copy long, host string, path string, hashes array<long>, open boolean")
        .withColumn("digest", F.sha2(F.array_join(F.transform("hashes", lambda h: h.cast("string")), ","), 256)),
        "hashed",
    )
    kinds = scratch.keep(
        hashed.groupBy("host", "digest").agg(
            F.min("path").alias("path"), F.max("open").alias("open"), F.first("hashes").alias("hashes")
        ),
        "kinds",
    )
    ranked = scratch.keep(
        global_rank(
            kinds.select("host", "path", "digest", "open"), [F.col(c) for c in ("host", "path", "digest")], scratch, "places"
        ),
        "ranked",
    )
    beside = ranked.select(*(F.col(c).alias(f"_{c}") for c in ("rank", "host", "path", "digest")))
    alike = F.expr(
        "size(filter(sequence(0, least(length(path), length(_path))), i -> left(path, i) = left(_path, i)))"
    )
    nearest = (
        ranked.where("open")
        .withColumn("_to", F.explode(F.array(F.col("rank") - 1, F.col("rank") + 1)))
        .join(beside.hint("merge"), (F.col("_to") == F.col("_rank")) & (F.col("host") == F.col("_host")))
        .groupBy("host", "digest")
        .agg(F.max(F.struct(alike.alias("alike"), (-F.col("_to")).alias("first"), "_digest")).alias("near"))
        .select("host", "digest", F.col("near._digest").alias("other"))
    )
    lines = kinds.select("host", "digest", "hashes")
    others = kinds.select("host", F.col("digest").alias("other"), F.col("hashes").alias("hashes2"))
    shared = (
        nearest.join(lines.hint("merge"), ["host", "digest"])
        .join(others.hint("merge"), ["host", "other"])
        .select("host", "digest", "hashes", "hashes2")
        .mapInArrow(_differences, "host string, digest string, shared array<int>")
    )
    return scratch.keep(
        hashed.where("open").select("id", "copy", "host", "digest").distinct()
        .join(shared.hint("merge"), ["host", "digest"])
        .select("id", "copy", "shared"),
        "shared",
    )


def main_texts(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A page becomes lines, one per block of its markup. A page is compared with the nearest other page of its
    host by path, and the lines on a longest common subsequence of the two are what the site repeats: they
    are deleted, unless the markup says that they are the article's own (a line may well be in two
    articles). Lines in elements that stand around a main text by name, class or role are deleted in any
    case, unless these are wrappers of the page (``verdicts``).

    Only pages with lines that the markup doesn't decide need their neighbour. NULL html is an empty page
    with empty text; NULL urls are a host of their own; NULL ids and repeated rows keep a row each. An empty
    table gives none.
    """
    page, url = F.coalesce(F.col("html"), F.lit("")), F.coalesce(F.col("url"), F.lit(""))
    rows = pages.select(id_key("page_id").alias("id"), "url", page.alias("html"), F.xxhash64(url, page).alias("copy"))
    addressed = rows.select(
        "id",
        "copy",
        F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)).alias("host"),
        F.regexp_extract(F.coalesce("url", F.lit("")), PATH, 1).alias("path"),
        "html",
    )
    return (
        rows.join(shared_with_nearest(addressed, scratch), ["id", "copy"], "left")
        .select("id", "url", "html", "shared")
        .mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
        .select(id_of("page_id").alias("page_id"), "url", "text", "n_chars")
    )
