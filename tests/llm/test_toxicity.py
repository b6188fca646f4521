"""The chain against a dense version with plain words, and the edges of its tables."""

import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from pagetables.llm import toxicity
from pagetables.llm.linear import Sparse, fit

CATEGORIES = ["quality", "toxic"]


def dense_fit(x, y, l2, rounds=60):
    """Newton's method on a dense matrix."""
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    ridge = np.append(np.full(x.shape[1] - 1, l2), 1e-12)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (p - y) / len(y) + ridge * w
        h = (x.T * (p * (1 - p))) @ x / len(y) + np.diag(ridge)
        w -= np.linalg.solve(h, g)
    return w


def plain_features(text):
    found = {}
    for w in {w for w in "".join(c if c.isalnum() and ord(c) < 128 or ord(c) >= 128 else " "
                                 for c in (text or "")).lower().split()}:
        for part in [w] + [w[:n] + "-" for n in toxicity.STEMS if len(w) > n]:
            found[part] = found.get(part, 0) + 1
    return found


def test_sparse_fit_is_the_dense_one():
    rng = np.random.default_rng(4)
    x = (rng.random((200, 6)) < 0.4) * rng.random((200, 6))
    y = (x[:, 0] + x[:, 1] > 0.5 + 0.3 * rng.random(200)).astype(float)
    weight = (np.arange(200) % 5 > 0).astype(float)
    row, col = np.nonzero(x[:, :4])  # the last columns as dense ones
    w, b = fit(Sparse(row, col, x[row, col], 200, 4, x[:, 4:]), y, weight, 1e-2, 500, 0)
    assert np.allclose(np.append(w, b), dense_fit(x[weight > 0], y[weight > 0], 1e-2), atol=1e-4)


def test_chain_is_the_dense_one(spark):
    rng = np.random.default_rng(8)
    common = [f"w{i}" for i in range(30)]
    docs, labels = [], []
    for i in range(240):
        toxic, bad = i % 4 == 0, i % 3 == 0
        ws = list(rng.choice(common, 12)) + ["nasty"] * (toxic and i % 8 > 0) + ["junkling"] * bad
        docs.append((i, " ".join(ws)))
        labels.append((i, int(not bad), int(toxic)))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    chain = toxicity.train(frame, known, CATEGORIES, l2=1e-3)
    parts = sorted({p for _, t in docs for p in plain_features(t) if zlib.crc32(p.encode()) in chain.vocabulary})
    assert "nasty" in parts and "junkl-" in parts and len(parts) == len(chain.vocabulary)
    x = np.array([[plain_features(t).get(p, 0) ** 0.5 for p in parts] for _, t in docs])
    fold = np.array([r["h"] % 5 for r in known.orderBy("doc_id").select(
        F.xxhash64("doc_id").alias("h")).collect()])
    odds = np.zeros((240, 0))
    for j in (1, 2):
        y = np.array([r[j] for r in labels], float)
        z, here = np.concatenate((x, odds), axis=1), np.zeros(240)
        for f in range(5):
            w = dense_fit(z[fold != f], y[fold != f], 1e-3)
            here[fold == f] = (z @ w[:-1] + w[-1])[fold == f]
        full = dense_fit(z, y, 1e-3)
        odds = np.concatenate((odds, here[:, None]), axis=1)
        if j == 1:
            first = x @ full[:-1] + full[-1]
    final = np.concatenate((x, first[:, None]), axis=1) @ full[:-1] + full[-1]
    got = {r.doc_id: r for r in toxicity.predict(frame, chain).collect()}
    p = np.array([[got[i].p_quality, got[i].p_toxic] for i in range(240)])
    want = 1 / (1 + np.exp(-np.stack((first, final), axis=1)))
    assert np.abs(p - want).max() < 0.03
    assert [got[i].toxic_pred for i in range(240)] == [bool(v >= chain.least[1]) for v in p[:, 1]]


def test_threshold_has_the_best_f1():
    rng = np.random.default_rng(1)
    for _ in range(40):
        z = np.round(rng.normal(size=30), 1)
        y = (rng.random(30) < 0.3).astype(float)
        def f1(at):
            called = 1 / (1 + np.exp(-z)) >= at
            return 2 * (called * y).sum() / max(called.sum() + y.sum(), 1)
        best = max(f1(1 / (1 + np.exp(-v)) - 1e-9) for v in z)
        got = toxicity.threshold(z, y)
        assert got == 0.5 if not 0 < y.sum() < 30 else f1(got) == pytest.approx(best)


@pytest.mark.parametrize("quarter", [0, 1])
def test_recall_on_two_quarters(spark, quarter):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.toxicity(docs, labels.filter(f"doc_id % 4 <> {quarter}")).join(
        labels.filter(f"doc_id % 4 = {quarter}"), "doc_id").collect()
    toxic = [r for r in rows if r.toxic == 1]
    clean = [r for r in rows if r.toxic == 0]
    assert sum(r.toxic_pred for r in toxic) / len(toxic) > 0.9
    assert sum(r.toxic_pred for r in clean) / len(clean) < 0.01


def test_empty_tables(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (98, 0, 1)], "doc_id bigint, quality int, toxic int")
    for docs, known, n in ((odd, labels.limit(0), 10), (odd.limit(0), labels, 0), (odd.limit(0), labels.limit(0), 0),
                           (odd, labels.filter("doc_id = 98"), 10), (odd, labels.filter("doc_id = 1"), 10)):
        rows = toxicity.toxicity(docs, known).collect()
        assert len(rows) == n and {(r.p_quality, r.p_toxic) for r in rows} <= {(0.5, 0.5)}


def test_the_sample_is_bounded_where_one_doc_id_repeats(spark):
    docs = spark.range(5000).select(F.lit(7).cast("bigint").alias("doc_id"),
                                    F.concat(F.lit("text number "), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 1)], "doc_id bigint, quality int, toxic int")
    assert toxicity._sampled(docs, labels, CATEGORIES, 100).count() == 100


def test_no_text_is_shuffled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    seen = []
    real = toxicity.in_arrow
    try:
        toxicity.in_arrow = lambda df, *a: seen.append(df._jdf.queryExecution().toString()) or real(df, *a)
        toxicity.toxicity(docs, labels).count()
    finally:
        toxicity.in_arrow = real
    joined = [p.split("== Physical Plan ==")[1] for p in seen if "Join" in p]
    assert joined and all("BroadcastHashJoin" in p and "hashpartitioning" not in p for p in joined)
