import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from auger.llm import langid


def test_held_out_accuracy(spark):
    from auger.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op7_language_id"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(lang)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.98


def test_matrix_equals_direct_counts(spark):
    rows = [("ab ab", "x"), ("ba", "x"), ("cc c", "y"), (None, "y"), ("zz", None), ("12", "x")]
    langs, table = langid.fit(spark.createDataFrame(rows, "text string, lang string"), bits=10, alpha=1.0)
    assert langs == ["x", "y"] and np.allclose(np.exp(table[:-1]).sum(axis=0), 1, atol=1e-3)
    count = np.ones((1024, 2))
    for t, k in (("ab ab", 0), ("ba", 0), ("cc c", 1)):
        np.add.at(count[:, k], langid._slots([t], 10)[0][:-1].ravel(), 1)
    assert np.allclose(table[:-1], np.log(count / count.sum(axis=0)), atol=1e-4)


def test_odd_texts(spark, odd_docs, no_docs):
    langs, table = langid.fit(odd_docs)
    assert langs == ["en"]
    rows = langid.predict(odd_docs, langs, table).collect()
    assert len(rows) == odd_docs.count() and "source" in rows[0].asDict()
    for r in rows:
        known = langid.has_letter(r["text"])
        assert r["lang_pred"] == ("en" if known else "und") and (r["score"] == 0.0) == (not known)
    assert langid.fit(no_docs)[0] == [] and langid.predict(no_docs, langs, table).count() == 0
    empty = langid.fit(no_docs)
    assert {r["lang_pred"] for r in langid.predict(odd_docs, *empty).collect()} == {"und"}


def test_long_text_counts_every_part(spark, monkeypatch):
    langs, table = langid.fit(spark.createDataFrame([("aaa bbb " * 20, "x"), ("ccc ddd " * 20, "y")], "text string, lang string"))
    long = "ccc " * 100 + "aaa bbb " * 400_000
    got = langid.predict(spark.createDataFrame([(1, long)], "doc_id long, text string"), langs, table).first()
    assert got["lang_pred"] == "x"


def test_slots_do_not_depend_on_the_languages(spark):
    df = spark.range(90).select(F.concat(F.lit("text"), "id").alias("text"), F.col("id").cast("string").alias("lang"))
    langs, table = langid.fit(df)
    assert len(langs) == 90 and table.shape == ((1 << 16) + 1, 90)


@pytest.mark.parametrize("block", [1, 7, 1 << 21])
def test_sparse_scores_equal_dense_ones(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK_CELLS", block)
    g = np.random.default_rng(5)
    weights = g.normal(size=((1 << 8) + 1, 3)).astype(np.float32)
    texts, slots = np.sort(g.integers(0, 6, 500)), g.integers(0, 1 << 8, 500)
    want, got = np.zeros((6, 3)), np.zeros((6, 3))
    np.add.at(want, texts, weights[slots].astype(np.float64))
    langid.add_log_likelihoods(got, texts, slots, weights)
    assert np.allclose(want, got)


def test_copies_teach_once(spark):
    rows = [(f"some english words number w{i}x", "x") for i in range(300)] + [("qqq qqq qqq", "x")] * 2000 + [(f"inne zdanie w{i}x", "y") for i in range(300)]
    once = langid.fit(spark.createDataFrame(sorted(set(rows)), "text string, lang string"), bits=10)
    copied = langid.fit(spark.createDataFrame(rows, "text string, lang string"), bits=10)
    assert once[0] == copied[0] and np.array_equal(once[1], copied[1])
    small = langid.fit(spark.createDataFrame(rows, "text string, lang string"), bits=10, per_lang=100)[1]
    assert 0.3 < np.exp(small[-1, 0]) < 0.7
