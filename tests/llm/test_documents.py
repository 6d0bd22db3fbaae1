"""The operators on documents, against brute force, on dirty rows, empty tables and the smallest test data."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import brute
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bazaarlake.llm import exact, lines, mixing, near, packing, quality, queries, secrets, suffixes

FOLDER = "/root/testdata/sf0.001"
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def bag(rows):
    return Counter(map(tuple, rows))


@pytest.fixture(scope="module", params=["dirty", "clashing", "sf0.001"])
def docs(request, spark):
    if request.param == "sf0.001":
        return spark.read.parquet(f"{FOLDER}/documents.parquet")
    return request.getfixturevalue(request.param)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_exact(docs, rows, scratch):
    found = exact.radix_groups(docs, scratch, with_text=True, width=4, growth=4).collect()
    want, n = brute.exact(rows)
    assert bag((r.doc_id, r.keep_id, r.group_size, brute.sha(r.text)) for r in found) == bag(want)
    assert sum(r.kept for r in found) == n
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_exact_dedup_keeps_columns(docs, rows, scratch):
    kept = exact.exact_dedup(docs, scratch)
    assert kept.dtypes == docs.dtypes
    assert Counter((r.text or "") for r in kept.collect()) == Counter({t or "" for _, t in rows})


def test_lines(docs, rows, scratch):
    bitmaps = scratch.keep(lines.keep_bitmaps(docs, scratch), "bitmaps")
    assert bag(lines.kept_digests(docs, bitmaps).collect()) == bag(brute.lines(rows))
    for r in bitmaps.collect():
        flags = lines.kept_flags(r.bitmap, r.lines)
        assert len(flags) == r.lines and r.lines - flags.sum() == r.n_dropped > 0


def test_mix(docs, rows, scratch):
    given = docs.select("doc_id", "text", "source").collect()
    want = brute.targets(given)
    found = mixing.mix(docs, scratch, block=16).collect()
    again = mixing.mix(docs, type(scratch)(docs.sparkSession, "again"), block=16).collect()
    assert bag(found) == bag(again) and len(found) == len(rows)
    taken = defaultdict(int)
    for r in found:
        assert (r.source_size, pytest.approx(r.target)) == want[r.source]
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for source, (_, target) in want.items():
        assert int(target) - 2 <= taken[source] <= target  # repeated rows share, rounded down


def test_mixed_documents(docs, scratch):
    out = mixing.mixed_documents(docs, scratch, block=16)
    assert out.dtypes == docs.dtypes
    words = out.agg(F.sum(mixing.n_words(F.col("text")))).first()[0]
    assert words == pytest.approx(sum(int(t) for _, t in brute.targets(docs.select("doc_id", "text", "source").collect()).values()), abs=200)


def test_mix_cuts_where_a_word_ends(spark, scratch):
    texts = {i: f"\t a{i}  b\n\nc\x0b d{i}\r\n e " * (i + 1) for i in range(12)}
    docs = spark.createDataFrame([(i, t, "en", "ab"[i % 2], len(t)) for i, t in texts.items()], DOCUMENT)
    found = mixing.mixed_documents(docs, scratch, block=16).collect()
    parts = [r for r in found if r.text != texts[r.doc_id]]
    assert all(texts[r.doc_id].startswith(r.text) and r.text and not r.text[-1].isspace() for r in parts)
    assert 0 < len(parts) <= 2 and all(r.n_chars == len(r.text) for r in parts)


def test_slots_are_made_by_many_tasks(spark, scratch, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE", 64)
    targets = spark.createDataFrame([("a", 4000, 9000.0), ("b", 900, 700.0)], "source string, source_size long, target double")
    slots = mixing.schedule(targets, block=2)
    assert "REPARTITION_BY_NUM" in slots._jdf.queryExecution().toString()
    of = slots.groupBy("source").agg(F.sum("tokens").alias("n")).collect()
    assert {r.source: r.n for r in of} == {"a": 9000, "b": 700}
    assert slots.select("slot").distinct().count() == slots.count()



def test_quality(docs, rows):
    ledger = quality.ledger(docs)
    found = quality.verdicts(ledger).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert bag((r.doc_id, *(r[n] for n in names)) for r in found) == bag((i, *brute.quality(t)) for i, t in rows)
    kept = quality.keep_good(docs)
    assert kept.dtypes == docs.dtypes
    assert bag((r.doc_id,) for r in kept.collect()) == bag((r.doc_id,) for r in found if r.kept)
    told = {r.rule: r for r in quality.ablation(ledger, quality.STRICT).collect()}
    for bit, rule in enumerate(quality.RULES):
        assert told[rule].n_failed == sum(r.failures >> bit & 1 for r in found)
        assert told[rule].n_only_this == sum(r.failures == 1 << bit for r in found)


def test_secrets(docs, rows, scratch):
    found = secrets.report(secrets.scan(docs, scratch)).collect()
    assert bag((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in found) == bag(
        (i, *brute.secrets(t)) for i, t in rows
    )


def test_near(docs, rows, scratch):
    found = near.near_duplicates(docs, scratch).collect()
    assert bag((r.doc_id, r.n_shingles, r.component_id) for r in found) == bag(brute.near(rows))
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_keep_one(docs, rows, scratch):
    kept = near.keep_one(docs, scratch)
    assert kept.dtypes == docs.dtypes
    want = {(c, n > 0 or i) for i, n, c in brute.near(rows)}
    assert len({(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect() if brute.shingles(r.text)}) == len(
        {c for c, full in want if full is True}
    )


def test_repeats(docs, rows, scratch):
    found = suffixes.repeated_spans(docs, scratch)
    assert bag(found.drop("spans").collect()) == bag(brute.repeats(rows))


def test_text_without_repeats(spark, scratch):
    """Spans may begin and end inside a character; halves of two characters make no third one."""
    passage = "".join(hashlib.sha256(bytes([i])).hexdigest() for i in range(9))
    # Each pair shares the second byte of a character before the passage and the first byte of one after it.
    texts = [f"eins \u00e9{passage}\u0101 zwei", f"drei \u0129{passage}\u0117 vier", f"f\u00fcnf{passage}sechs{passage}", "sieben \u0101", passage * 2, None]
    data = [*enumerate(texts), (7, texts[3]), (7, texts[3]), (None, f"acht{passage[40:]}")]
    found = suffixes.without_repeats(spark.createDataFrame(data, "doc_id long, text string"), scratch).collect()
    assert bag(r[:5] for r in found) == bag(brute.repeats(data))
    assert bag((r.doc_id, r.text) for r in found) == bag(
        [(0, "eins  zwei"), (1, "drei  vier"), (2, "f\u00fcnfsechs"), (3, texts[3]), (4, ""), (5, ""), (7, texts[3]), (7, texts[3]), (None, "acht")]
    )


def check_packing(pieces, rows, capacity=4096):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            own = ids[start : start + capacity]
            crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own))
            want[doc_id, piece, start, len(own), crc] += 1
    assert bag((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    sequences = defaultdict(list)
    for r in pieces:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(docs, rows, scratch):
    pieces = packing.pack(docs, scratch, TOKENIZER).collect()
    n = check_packing(pieces, rows)
    assert n <= -(-sum(r.length for r in pieces) // 4096) + 1


def fewest(lengths, capacity):
    """Sequences that an exhaustive search needs."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def search(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= lengths[i]}:
            at = rooms.index(room)
            rooms[at] -= lengths[i]
            search(i + 1, rooms)
            rooms[at] += lengths[i]
        search(i + 1, [*rooms, capacity - lengths[i]])

    search(0, [])
    return best[0]


def test_plan_is_close_to_the_fewest():
    random.seed(5)
    over = 0
    for _ in range(400):
        capacity = random.choice([10, 23, 40])
        lengths = [random.randint(1, capacity) for _ in range(random.randint(1, 9))]
        sequences = packing.plan(Counter(lengths), capacity)
        assert Counter(itertools.chain(*(m * n for m, n in sequences))) == Counter(lengths)
        assert all(sum(m) <= capacity for m, _ in sequences)
        over += sum(n for _, n in sequences) - fewest(lengths, capacity)
    assert over <= 2


def test_dominating_sets_never_cost_a_sequence():
    random.seed(6)
    proven = 0
    for _ in range(600):
        capacity = random.choice([10, 23, 40])
        lengths = sorted(random.randint(1, capacity) for _ in range(random.randint(1, 8)))
        rest = Counter(lengths[:-1])
        partners = packing.dominating_set(lengths[-1], sorted(rest), rest, capacity)
        if partners is not None:
            proven += 1
            left = list((rest - Counter(partners)).elements())
            assert 1 + fewest(left, capacity) == fewest(lengths, capacity)
    assert proven > 300


def test_encoder_on_texts_with_everything():
    texts = ["it's 'd '' \"'re <|endoftext|> ßÀÿ 9's", "Σας ΟΔΟΣ İ ª\x85b\xa0\x1cd", "", "ﬁ é 日本語", "a\tb\r\nC"]
    encoder, tokenizer = packing.Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    for text in texts:
        want = b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(text, add_special_tokens=False).ids)
        assert encoder.encode(text) == want


def test_empty_tables(empty, scratch):
    again = lambda: type(scratch)(empty.sparkSession, "empty")
    assert exact.radix_groups(empty, again()).count() == 0
    assert lines.kept_digests(empty, lines.keep_bitmaps(empty, again())).count() == 0
    assert mixing.mix(empty, again()).count() == 0
    assert quality.ledger(empty).count() == quality.keep_good(empty).count() == 0
    assert secrets.scan(empty, again()).count() == 0
    assert near.near_duplicates(empty, again()).count() == near.keep_one(empty, again()).count() == 0
    assert suffixes.repeated_spans(empty, again()).count() == 0
    assert packing.pack(empty, again(), TOKENIZER).count() == 0


def test_long_runs_cross_many_edges(spark, scratch):
    """One line and one passage in most documents, over more partitions than runs have rows for."""
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    passage = " ".join(hashlib.sha256(bytes([i])).hexdigest() for i in range(9))
    data = [(i, f"{'x' * (i % 5)} {i}\na line that all of them share\n{passage}{i % 3}") for i in range(300)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    bitmaps = scratch.keep(lines.keep_bitmaps(docs, scratch), "bitmaps")
    assert bag(lines.kept_digests(docs, bitmaps).collect()) == bag(brute.lines(data))
    found = suffixes.repeated_spans(docs, type(scratch)(spark, "edges"))
    assert bag(found.drop("spans").collect()) == bag(brute.repeats(data))


def test_texts_that_repeat_themselves(spark, scratch, monkeypatch):
    """Short and long periods; runs just long enough or too short."""
    rule = hashlib.sha256(b"rule").hexdigest() * 2
    data = []
    for n, period in enumerate([1, 2, 5, 13, 64, 100]):
        unit = rule[n : n + period]
        for m, length in enumerate([399, 400, 401, 400 + period - 1, 400 + period, 1500]):
            run = (unit * 1500)[:length]
            data += [(20 * n + m, f"<{n} {m}{run}>{m}"), (20 * n + m + 10, run)]
    data += [(900, "=" * 390 + "\n" + "=" * 450 + "\n" + "=" * 390), (901, ("| --- " * 90 + "\n") * 5), (901, "| --- " * 70)]
    for length in (suffixes.SLICE, 700):  # the second: texts of several slices
        monkeypatch.setattr(suffixes, "SLICE", length)
        found = suffixes.repeated_spans(spark.createDataFrame(data, "doc_id long, text string"), type(scratch)(spark, f"own{length}"))
        assert bag(found.drop("spans").collect()) == bag(brute.repeats(data))


def test_long_text_of_one_character_has_few_suffixes():
    slices = ["a" * 1_000_000, ("| --- " * 12 + "|\n") * 12_000]
    for text in slices:
        (of, *_), (own, lo, hi) = suffixes.anchors([text.encode()])
        assert len(of) < 40 and lo.tolist() == [0] and hi.tolist() == [len(text) - suffixes.LENGTH]


def test_near_copies_of_copies(spark, scratch):
    """A large group whose members are mostly unlike each other, and chains."""
    random.seed(7)
    words = [f"v{i}" for i in range(150)]
    data = []
    for i in range(150):
        own = list(words)
        for _ in range(random.randint(0, 9)):
            own[random.randrange(150)] = f"u{random.randrange(10**9)}"
        data.append((i, " ".join(own)))
        if i % 3 == 0:
            words[random.randrange(150)] = f"c{i}"
    docs = spark.createDataFrame(data, "doc_id long, text string")
    found = near.near_duplicates(docs, scratch).collect()
    assert bag((r.doc_id, r.n_shingles, r.component_id) for r in found) == bag(brute.near(data))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_sql(spark, name):
    import compare

    duck = compare.connect(FOLDER)
    assert compare.spark_rows(queries.QUERIES[name](spark, FOLDER)) == compare.duck_rows(duck, queries.SQL[name])


def _listing(n):
    """Lines of digests, as in a list of checksums."""
    return "\n".join(f"{hashlib.md5(str(i).encode()).hexdigest()}  é{i}.txt token={i:012d}" for i in range(n))


def test_secrets_of_a_text_with_very_many(spark, scratch):
    given = [(1, _listing(9000)), (2, _listing(63)), (3, _listing(64)), (4, _listing(65)), (5, _listing(4097))]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    found = {r.doc_id: tuple(r)[:5] for r in secrets.report(secrets.scan(docs, scratch)).collect()}
    assert found == {i: (i, *brute.secrets(t)) for i, t in given}
