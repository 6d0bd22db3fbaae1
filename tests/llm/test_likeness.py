"""Near-duplicates of a corpus: shingles of five words, links at 80 %."""

import random

import brute
import corpus_pipeline
from bazaarlake.llm import near
from test_documents import bag, check_packing

FOLDER = "/root/testdata/sf0.001"


def edited(words, places):
    return " ".join(f"new{i}" if i in places else w for i, w in enumerate(words))


def test_corpus_likeness(spark, scratch):
    random.seed(5)
    data = []
    for i in range(60):
        words = [f"d{i}w{k}" for k in range(200)]
        # One block of 16: 81.5 % on five words. Five words apart: 77 %. Four words apart: 81 %.
        places = [range(80, 96), range(20, 200, 40), range(20, 180, 45)][i % 3]
        data += [(2 * i, " ".join(words)), (2 * i + 1, edited(words, places))]
    data += [(200, "a b c d"), (201, "A B C d"), (202, None), (203, "a b c")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    want = brute.near(data, 80, 5)
    found = near.near_duplicates(docs, scratch, near.CORPUS).collect()
    assert bag((r.doc_id, r.n_shingles, r.component_id) for r in found) == bag(want)
    kept = near.keep_one(docs, type(scratch)(spark, "kept"), near.CORPUS)
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in want}


def test_stage_links_at_five_words_and_80_percent(spark):
    words = [f"w{k}" for k in range(200)]
    others = [f"v{k}" for k in range(200)]
    data = [
        (1, " ".join(words)),
        (2, edited(words, range(80, 96))),
        (3, " ".join(others)),
        (4, edited(others, range(20, 200, 40))),
    ]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert {r.doc_id for r in stage(spark, docs, FOLDER).collect()} == {1, 3, 4}


def test_stages_after_it(spark, scratch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(scratch.keep(stage(spark, out[-1], FOLDER), f"stage_{name}"))
    *_, distinct, apart, mixed, packed = out
    want = {c for _, _, c in brute.near([(r.doc_id, r.text) for r in distinct.select("doc_id", "text").collect()], 80, 5)}
    assert {r.doc_id for r in apart.collect()} == want and apart.count() == len(want)
    sizes = brute.targets([tuple(r) for r in apart.select("doc_id", "text", "source").collect()])
    words = {}
    for r in mixed.collect():
        words[r.source] = words.get(r.source, 0) + len(brute.WORD.findall(r.text))
    assert words == {s: int(t) for s, (_, t) in sizes.items() if int(t)}
    check_packing(packed.collect(), [(r.doc_id, r.text) for r in mixed.select("doc_id", "text").collect()])
