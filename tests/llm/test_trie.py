"""The trie of conversations against every prefix of every conversation."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from bazaarlake.llm import trie

LOWEST = -(2**63)
SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture
def history(spark):
    conv = F.col("conv")
    return {"base": conv - conv % 5, "history": F.crc32(conv.cast("string")) % 9}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def key(x):
    return LOWEST if x is None else x


def sequences(rows, rebuilt=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        own[conv].append((key(turn), role, sha(sha(role) + sha(text)), text))
    for turns in own.values():
        turns.sort()
    out = {}
    for conv, turns in own.items():
        turns = [(r, t) for _, r, _, t in turns]
        if rebuilt and conv is not None:
            h = zlib.crc32(str(conv).encode()) % 9
            base = [(r, t) for _, r, _, t in own.get(conv - int(math.fmod(conv, 5)), [])]
            turns = base[:h] + turns[h:]
        out[conv] = tuple(turns)
    return out


def brute(rows, rebuilt=True):
    seqs = sequences(rows, rebuilt)
    members, children = defaultdict(list), Counter()
    for conv, turns in seqs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join("" if c is None else str(c) for c in sorted((c for c in m if seqs[c] == p), key=key))
        parent = min(members[p[:-1]], key=key) if p else None
        out.append((min(m, key=key), len(p), parent, len(m), children[p], leaves[p], saved[p], sha(ends)))
    return Counter(out)


def found(df):
    return Counter(map(tuple, df.collect()))


def family(seed, n=120):
    """Conversations that share beginnings, end inside others, repeat others and differ in one turn."""
    rng = random.Random(seed)
    rows, told = [], [[]]
    for conv in rng.sample(range(-200, 400), n):
        turns = rng.choice(told)[: rng.randint(0, 12)] if rng.random() < 0.8 else []
        turns = turns + [(rng.choice("ua"), rng.choice(["", "é", "yes", "no", "x" * 40])) for _ in range(rng.choice([0, 0, 1, 2, 9]))]
        told.append(turns)
        rows += [(conv, i, r, t) for i, (r, t) in enumerate(turns)]
    return rows


def test_sf(spark, scratch, history):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()]
    assert found(trie.prefix_trie(turns, scratch, **history)) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_families(spark, scratch, history, seed):
    rows = family(seed)
    turns = spark.createDataFrame(rows, SCHEMA)
    assert found(trie.prefix_trie(turns, scratch, **history)) == brute(rows)
    plain = trie.prefix_trie(turns, type(scratch)(spark, "plain"))
    assert found(plain) == brute(rows, rebuilt=False)


def test_odd_rows(spark, scratch, history, monkeypatch):
    """NULLs, repeated rows, ties, clashing columns, a chain of 300 turns over many partitions and steps."""
    monkeypatch.setattr(trie, "STEP", 7)
    monkeypatch.setattr(trie, "IDS", 3)
    rows = [
        (None, 1, "u", "a"),
        (None, None, "u", "b"),
        (3, None, None, None),
        (3, 1, "u", "same"),
        (3, 1, "u", "same"),
        (3, 1, "a", "tie"),
        (4, 0, "u", None),
        (-6, 0, "u", "minus"),
        (-5, 0, "u", "base"),
        *((c, i, "u", f"turn {i}") for c in (10, 11, 12, 13, 14, 25) for i in range(300 if c == 10 else 150)),
        *((100 + c, 0, "u", "one") for c in range(20)),
    ]
    turns = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS conv", "'y' AS hash", "1 AS depth", "2 AS key")
    assert found(trie.prefix_trie(turns, scratch, **history)) == brute(rows)
    assert found(trie.prefix_trie(turns, type(scratch)(spark, "plain"))) == brute(rows, rebuilt=False)


def test_empty(spark, scratch, history):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA), scratch, **history).collect() == []


def test_conversation_over_many_partitions(spark, scratch):
    rows = [(1, i, "u", str(i)) for i in range(500)] + [(2, i, "u", str(i)) for i in range(400)]
    own = trie.turns(spark.createDataFrame(rows, SCHEMA), scratch)
    at = {(r.conv, r["at"]): (r.prev, r.hash, r.bytes) for r in own.collect()}
    assert len(at) == 900
    for i in range(1, 401):
        assert at[1, i] == at[2, i]
        assert at[1, i][0] == (at[1, i - 1][1] if i > 1 else trie.ROOT)
    assert len({h for _, h, _ in at.values()}) == 500


def test_two_fattest(spark):
    pairs = [(lo, hi) for hi in range(1, 70) for lo in range(hi)]
    rows = spark.createDataFrame(pairs, "lo long, hi long").withColumn("f", trie.two_fattest("lo", "hi"))
    for r in rows.collect():
        best = max(range(r.lo + 1, r.hi + 1), key=lambda x: x & -x)
        assert r.f == best


def test_only_touched_edges_are_opened(spark, scratch):
    """A batch that repeats what is known adds no prefix but those on the edges where it leaves."""
    rows = [(c, i, "u", f"{c // 50 if i < 30 else c} {i}") for c in range(100) for i in range(40)]
    paths = trie.paths(spark.createDataFrame(rows, SCHEMA), scratch)
    trie.compacted(paths, scratch)
    last = spark.read.parquet(f"{scratch.root}/batch2_region")
    late = spark.read.parquet(f"{scratch.root}/batch2_located")
    assert late.where("top < 30").isEmpty()
    assert last.count() == late.count() * 10
