"""The pipeline's stages, each against brute force on what its predecessor kept."""

import brute
import corpus_pipeline
import pytest
from test_documents import check_packing

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", params=["sf0.001", "clashing"])
def stages(request, spark):
    from bazaarlake.llm.common import Scratch

    scratch = Scratch(spark, "stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet") if request.param == "sf0.001" else request.getfixturevalue("clashing")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(scratch.keep(stage(spark, out[-1], FOLDER), name))
    return out


def texts(docs):
    return sorted((brute.key(r.doc_id), r.text or "") for r in docs.select("doc_id", "text").collect())


def test_every_stage_works_on_what_is_left(stages):
    given, good, distinct, apart, mixed, packed = stages
    assert all(s.dtypes == given.dtypes for s in (good, distinct, apart, mixed))

    start = [(r.doc_id, r.text) for r in given.select("doc_id", "text").collect()]
    left = {x for x in texts(good)}
    assert left <= set(texts(given))
    assert all(not brute.quality(t)[-1] for _, t in left)

    kept = {t: max(i for i, u in texts(good) if u == t) for _, t in left}
    assert texts(distinct) == sorted((i, t) for t, i in kept.items())

    pairs = [(r.doc_id, r.text) for r in distinct.select("doc_id", "text").collect()]
    ids = {c for _, n, c in brute.near(pairs, percent=80, width=5)}
    assert {r.doc_id for r in apart.select("doc_id").collect()} == ids and apart.count() == len(ids)

    sizes = brute.targets([tuple(r) for r in apart.select("doc_id", "text", "source").collect()])
    words = {}
    for r in mixed.collect():
        words[r.source] = words.get(r.source, 0) + len(brute.WORD.findall(r.text))
    assert words == {s: int(t) for s, (_, t) in sizes.items() if int(t)}

    check_packing(packed.collect(), [(r.doc_id, r.text) for r in mixed.select("doc_id", "text").collect()])
    assert len(start) >= len(left)


def test_run_is_all_stages(spark):
    pieces = corpus_pipeline.run(spark, FOLDER)
    assert pieces.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert pieces.count() > 100
