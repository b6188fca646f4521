"""Whitening against plain NumPy and plain integers."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from pagetables.llm import whitening

KEYS = ("n", "deviation", "explained")


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    return df.withColumn("x", F.lit("clash")).withColumn("n", F.lit("clash")).withColumn("component", F.lit(0))


def check(rows, vectors, components=16, scale=64, offset=1_000_000):
    """``vectors``: (vec_id, entries) of the usable rows."""
    x = [[int(np.floor(scale * np.float64(c))) + offset for c in v] for _, v in vectors]
    fit = np.array(sorted(set(map(tuple, x))), object)
    n, sums = len(fit), [sum(int(v) for v in c) for c in fit.T]
    centred = np.array([[n * int(v) - s for v, s in zip(r, sums)] for r in fit], object)
    cov = (centred.T @ centred).astype(float) / n ** 3
    values = np.linalg.eigvalsh(cov)[::-1]
    k = min(components, int((values > 1e-13 * values[0]).sum()))
    by_row = {}
    for r in rows:
        by_row.setdefault(r.vec_id, []).append(r)
    assert len(rows) == k * len(vectors)
    white = {}
    for (vec_id, _), xs in zip(vectors, x):
        deviation = sum((n * v - s) ** 2 for v, s in zip(xs, sums))
        got = [r for r in by_row[vec_id] if int(r.deviation) == deviation]
        assert {r.component for r in got} == set(range(1, k + 1))
        by = {r.component: r.whitened for r in got}
        white[tuple(xs)] = [by[c] for c in range(1, k + 1)]
        for r in got:
            assert r.n == n and r.identity_error <= 1e-4
            assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-6)
    z = np.array([white[tuple(r)] for r in fit])
    assert np.abs(np.cov(z.T, bias=True).reshape(k, k) - np.eye(k)).max() < 1e-6
    assert np.abs(z.mean(axis=0)).max() < 1e-6
    # each component is an eigenvector: the whitened rows give it back
    back = centred.astype(float).T @ z / n ** 2 / np.sqrt(values[:k])
    assert np.abs(cov @ back - back * values[:k]).max() < 1e-6 * values[0]


def test_scatter_by_planes_is_exact():
    rng = np.random.default_rng(3)
    for top, rows, d in ((1, 1, 1), (2, 63, 3), (200, 65, 5), (2**31, 130, 4), (2**62, 200, 3)):
        x = rng.integers(-top, top, (rows, d), dtype=np.int64)
        z = np.concatenate((x, np.ones((rows, 1), np.int64)), axis=1).astype(object)
        assert (whitening.block_scatter(x) == z.T @ z).all()
    low, high = -2**63, 2**63 - 1
    x = np.array([[low, high], [high, low], [0, -1]], np.int64)
    z = np.concatenate((x, np.ones((3, 1), np.int64)), axis=1).astype(object)
    assert (whitening.block_scatter(x) == z.T @ z).all()


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    vectors = [(r.vec_id, r.embedding) for r in df.collect()]
    check(whitening.whiten(df).collect(), vectors)


def test_repeated_rows_count_once_in_the_fit(spark):
    rng = np.random.default_rng(5)
    base = [(i, rng.normal(size=6).tolist()) for i in range(40)]
    rows = base + [(100 + i, base[0][1]) for i in range(60)] + [base[3], (None, base[4][1])]
    check(whitening.whiten(table(spark, [(i, v, 0) for i, v in rows]), components=4).collect(), rows, 4)


def test_large_and_flat_entries(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) * 1e12, 7.0, float(w), -3.5e15]) for i, (v, w) in enumerate(rng.normal(size=(30, 2)) * 4)]
    found = whitening.whiten(table(spark, [(i, v, 0) for i, v in rows])).collect()
    assert {r.component for r in found} == {1} and len(found) == 30  # the rest is below precision
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    want = {i: sum((30 * v - s) ** 2 for v, s in zip(r, sums)) for (i, _), r in zip(rows, x)}
    assert {r.vec_id: int(r.deviation) for r in found} == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.1, 0.2]), (2, [0.5, -0.2]), (2, [0.9, 0.7]), (None, [-0.3, 0.6]), (4, [-0.3, 0.6])]
    bad = [(5, None), (6, [0.1, None]), (7, [nan, 0.1]), (8, [inf, 0.1]), (9, [-inf, 0.1]), (10, []),
           (11, [0.1]), (12, [0.1, 0.2, 0.3]), (13, [1e300, 0.0])]
    check(whitening.whiten(table(spark, [(i, v, None) for i, v in good + bad])).collect(), good)
    for rows in (bad[:6], [], [(1, [0.1, 0.2], 0)], [(1, [0.1, 0.2], 0)] * 3):
        rows = [r if len(r) == 3 else (*r, 0) for r in rows]
        assert whitening.whiten(table(spark, rows)).collect() == []


def test_work_of_the_driver_does_not_grow(spark):
    rows = [(i, [float(i % 97), float(i % 89), float(i % 83)], 0) for i in range(20_000)]
    ints = whitening.integer_vectors(table(spark, rows).repartition(7))
    total = whitening.total_scatter(ints.select("x"), 3)
    x = np.array([[64 * int(c) + 1_000_000 for c in v] + [1] for _, v, _ in rows], object)
    assert (total == x.T @ x).all()
