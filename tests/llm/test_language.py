"""The byte network: gradients, accuracy on documents that it has not seen, and odd texts."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from bazaarlake.llm import language

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = language.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(found) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    unseen = [r for r in found if r.held_out]
    right = [r.lang == r.lang_pred for r in unseen if any(map(str.isalpha, r.text))]
    assert len(right) > 200 and sum(right) / len(right) >= 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_learns_from_nothing_held_out(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    wrong = docs.withColumn("lang", F.when(language.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a, b = language.train(docs, 40), language.train(wrong, 40)
    assert a.languages == b.languages and np.array_equal(a.filters, b.filters)


def test_odd_texts(spark, dirty, clashing, empty):
    rows = dirty.collect()
    for docs in (dirty, clashing):
        found = language.identify(docs).collect()
        assert len(found) == len(rows)
        texts = {r.doc_id: r.text for r in rows if r.doc_id is not None}
        langs = {r.lang for r in rows if r.lang}
        for r in found:
            if r.doc_id is not None:
                letters = any(map(str.isalpha, texts[r.doc_id] or ""))
                assert r.lang_pred in langs if letters else (r.lang_pred, r.score) == ("und", 0.0)
            else:
                assert r.held_out is False
    assert language.identify(empty).collect() == []
    unlabelled = language.identify(dirty.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}


def test_whole_texts_count(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    net = language.train(docs, 100)
    texts = {r.lang: r.text for r in docs.where("length(text) > 1000 AND lang IN ('de', 'en')").collect()}
    de, en = texts["de"][:900], texts["en"][:900]
    mixed = [(1, de + 40 * en), (2, en + 40 * de), (3, 3000 * de)]
    found = language.predict(spark.createDataFrame(mixed, "doc_id long, text string"), net).collect()
    assert [r.lang_pred for r in sorted(found, key=lambda r: r.doc_id)] == ["en", "de", "de"]


def test_pooling_is_the_plain_convolution():
    rng = np.random.default_rng(2)
    net = language.Network.new(["a", "b"], rng)
    rows = rng.integers(0, 256, (3, language.WINDOW)).astype(np.uint8)
    pooled, where = net.pooled(net.embedded(rows), places=True)
    numbers = net.embedded(rows)
    for n in range(3):
        answers = np.array([numbers[n, p : p + 4].ravel() @ net.filters for p in range(language.WINDOW)])
        assert np.allclose(pooled[n], answers.max(0) + net.bias, atol=1e-4)
        assert np.allclose(answers[where[n], np.arange(answers.shape[1])] + net.bias, pooled[n], atol=1e-4)
    narrow = net.filters[language.EMBEDDING * language.WIDTHS[0] :, : language.FILTERS]
    assert not narrow.any()


def test_fit_separates_alphabets():
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.integers(97, 105, (80, 256)), rng.integers(105, 113, (80, 256))]).astype(np.uint8)
    labels = np.repeat([0, 1], 80)
    net = language.fit(rows, labels, ["a", "b"])
    assert (net.answers(rows).argmax(1) == labels).all()
