"""Learned operators: held-out accuracy on the given tables, and odd rows."""

import numpy as np
import pyarrow as pa
import pytest

from pagetables.llm import langid, licences, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_held_out_accuracy(corpus):
    rows = langid.language_of(corpus).join(corpus.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and np.mean([r.lang_pred == r.lang for r in held]) > 0.98
    assert sum(r.rejected for r in rows) <= 0.002 * len(rows)


def test_language_odd_rows(corpus, documents):
    model = langid.train(corpus)
    texts = [None, "", " 12 ?!", "漢字かな交じり文", "the and of to in that was with for on " * 3]
    got = langid.identify(documents(texts), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and all(r.rejected for r in got[:4])
    assert got[3].lang_pred in model.langs and (got[4].lang_pred, got[4].rejected) == ("en", False)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_counts_do_not_depend_on_the_batch():
    texts = [b"x", b"word and word", "\u00e9t\u00e9".encode(), b"", None, b" a", b"1", b"z"]
    together, letters = langid.counts(texts)
    assert letters.tolist() == [1, 11, 3, 0, 0, 1, 0, 1]
    assert together[0].sum() == 3
    for order in (texts[::-1], texts[1:] + texts[:1]):
        again, n = langid.counts(order)
        for t in texts:
            i, j = texts.index(t), order.index(t)
            assert n[j] == letters[i] and (again[j] == together[i]).all()
    for i, t in enumerate(texts):
        alone, n = langid.counts([t])
        assert n[0] == letters[i] and (alone[0] == together[i]).all()
    assert langid.counts([])[0].shape == (0, langid.DIM)


def test_language_nothing_to_learn_from(odd):
    from pyspark.sql import functions as F

    rows = langid.language_of(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(rows) == 10 and {r.lang_pred for r in rows} == {"und"}
    assert langid.language_of(odd).count() == 10 and langid.language_of(odd.limit(0)).count() == 0
    assert langid.keep_known(odd).columns == odd.columns


def test_toxicity_held_out_accuracy(spark, corpus):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    seen, unseen = labels.filter("doc_id % 4 <> 0"), labels.filter("doc_id % 4 = 0")
    rows = toxicity.toxicity(docs, seen).join(unseen, "doc_id").collect()
    toxic = [r.toxic_pred if "toxic_pred" in r else r.p_toxic >= 0.5 for r in rows]
    truth = [r.toxic == 1 for r in rows]
    recall = sum(t and p for t, p in zip(truth, toxic)) / sum(truth)
    wrong = sum(p and not t for t, p in zip(truth, toxic)) / (len(truth) - sum(truth))
    assert recall > 0.9 and wrong < 0.01


def test_toxicity_words_of_one_category_do_not_crowd_out_the_other(spark):
    from pyspark.sql import functions as F

    # 500 strong words of bad quality and 10 weaker ones of toxic texts
    docs = spark.range(2000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.array_join(F.transform(
            F.sequence(F.lit(0), F.lit(499)), lambda i: F.format_string("q%03d", i)), " "))
        .otherwise("plain").alias("q"), (F.col("id") % 20 == 7).cast("int").alias("toxic"))
    docs = docs.withColumn("text", F.concat_ws(" ", "q", F.when(
        F.col("toxic") == 1, F.format_string("t%02d", (F.col("doc_id") / 20).cast("int") % 10))))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), "toxic")
    rows = toxicity.toxicity(docs.select("doc_id", "text"), labels).join(labels, "doc_id").collect()
    assert all((r.p_toxic >= 0.5) == (r.toxic == 1) for r in rows)


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (4, 0, 1), (None, 1, 1), (99, 1, 1), (4, 0, 1)],
                                   "doc_id bigint, quality int, toxic int")
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == 10 and all(0 <= r.p_toxic <= 1 and 0 <= r.p_quality <= 1 for r in rows)
    none = toxicity.toxicity(odd, labels.limit(0)).collect()
    assert {r.p_toxic for r in none} == {0.5}
    assert toxicity.toxicity(odd.limit(0), labels).count() == 0


def test_licences_of_the_corpus(corpus):
    notes = {"Released under the MIT License.": "MIT", "All rights reserved.": "Proprietary",
             "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
             "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
             "This work is licensed under the GNU General Public License, version 3.": "GPL"}
    found = {r.doc_id: r.licences for r in licences.scan(corpus, licences.train(corpus)).collect()}
    for r in corpus.collect():
        want = sorted({notes[x] for x in r.text.split("\n") if x in notes})
        assert found[r.doc_id] == want


def test_licence_variants_and_unknown(corpus):
    model = licences.train(corpus)
    scan = lambda *p: model.scan("\n".join(p).encode())[0]
    assert scan("This project is released under the MIT License") == ["MIT"]
    assert scan("licensed under the APACHE LICENSE, version 2.0", "Released under the BSD License.") == [
        "Apache-2.0", "BSD"]
    assert scan("She reserved all rights to the two front seats of the public bus") == []
    assert scan("", "thonwh enerre") == [] and scan() == []


def test_licence_odd_rows(odd):
    model = licences.train(odd)
    rows = licences.scan(odd, model).collect()
    assert len(rows) == 10 and all(r.licences == [] for r in rows)
    assert licences.scan(odd.limit(0), licences.train(odd.limit(0))).count() == 0


def test_language_counts_few_texts_at_once():
    """Each text has a row of counts, however short it is."""
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 600 + [None] * 600)], ["text"])
    cuts = [texts for _, texts in langid.by_text([batch], limit=langid.TEXT_BYTES, most=langid.TEXTS)]
    assert max(map(len, cuts)) <= 256 and sum(map(len, cuts)) == 1200
