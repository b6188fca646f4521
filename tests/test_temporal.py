"""Walks along links, as-of and interval joins, changes between runs."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F

from pagetables.operators import temporal as T
from pagetables.operators import walk as W

START = datetime(2024, 1, 1)


def walked(links):
    """Start and step of each page, by walking."""
    kept = {}
    for page, following in sorted(links):
        if following is not None and following != page and following in dict(links) and following not in kept:
            kept[following] = page
    back_to = {p: kept.get(p) for p, _ in links}
    out = {}
    for p in back_to:
        path = [p]
        while (q := back_to[path[-1]]) is not None and q != p:
            path.append(q)
        if q == p:  # round a cycle
            low = min(path)
            out[p] = (low, path.index(low))
        else:
            out[p] = (path[-1], len(path) - 1)
    return out


def order(spark, links, tmp_path):
    df = spark.createDataFrame([("s", p, n) for p, n in links], "source string, page_id bigint, next_page_id bigint")
    return {r.page_id: (r.start_page_id, r.step) for r in W.walk_order(df, work_dir=str(tmp_path)).collect()}


def test_paths_cycles_and_gaps(spark, tmp_path):
    links = [(5, 2), (2, 9), (9, None), (1, 1), (30, 20), (20, 40), (40, 30), (50, 51), (51, 99),
             (60, 62), (61, 62), (62, 63), (63, 62), (70, 71), (71, 70)]
    got = order(spark, links, tmp_path)
    assert got == walked(links)
    assert got[9] == (5, 2) and got[1] == (1, 0) and got[30] == (20, 2) and got[51] == (50, 1)
    assert got[62] == (60, 1) and got[61] == (61, 0)


def test_random_links(spark, tmp_path):
    rng = random.Random(3)
    for n in (1, 40):
        links = [(i, rng.choice([None, rng.randrange(n + 3), i + 1])) for i in range(n)]
        rng.shuffle(links)
        assert order(spark, links, tmp_path) == walked(links)
    assert order(spark, [], tmp_path) == {}


def test_rounds_grow_with_the_logarithm(spark, tmp_path):
    seen = []
    real = W.materialise
    try:
        W.materialise = lambda df, name, work_dir=None: seen.append(name) or real(df, name, work_dir)
        n = 700
        got = order(spark, [(i * 37 % n, (i + 1) * 37 % n) for i in range(n - 1)] + [((n - 1) * 37 % n, None)], tmp_path)
    finally:
        W.materialise = real
    assert {p: s for p, (_, s) in got.items()} == {i * 37 % n: i for i in range(n)}
    assert seen.count("walk") <= 11


def test_pages_are_ordered_within_their_source(spark, pages, tmp_path):
    page = lambda n: f"<a href='/p{n}'>Next</a>"
    df = spark.createDataFrame(
        [(1, "http://a.test/p1", page(3), "x"), (2, "http://a.test/p3", page(2), "x"), (3, "http://a.test/p2", "end", "x"),
         (4, "http://a.test/p1", page(2), "y"), (5, "http://a.test/p2", "<a href='javascript:n()'>Next</a>", "y")],
        "page_id bigint, url string, html string, source string")
    got = W.order_pages(df, work_dir=str(tmp_path)).orderBy("page_id").collect()
    assert [(r.start_page_id, r.step) for r in got] == [(1, 0), (1, 1), (1, 2), (4, 0), (4, 1)]
    assert got[0].html == page(3)


# --- as-of join --------------------------------------------------------------------------

def sides(spark, left, right):
    at = lambda t: None if t is None else START + timedelta(seconds=t)
    return (spark.createDataFrame([(i, k, at(t)) for i, (k, t) in enumerate(left)], "i int, k int, t timestamp"),
            spark.createDataFrame([(k, at(t), v) for k, t, v in right], "k int, s timestamp, v int"))


@pytest.mark.parametrize("strict, tolerance", [(False, None), (True, None), (False, 20), (True, 5)])
def test_asof_against_a_scan(spark, strict, tolerance):
    rng = random.Random(11)
    left = [(0 if i % 3 else rng.randrange(5), rng.randrange(300)) for i in range(400)] + [(None, 5), (1, None), (77, 5)]
    right = [(0 if i % 3 else rng.randrange(5), rng.randrange(300), i) for i in range(300)] + [(None, 1, 1), (1, None, 1)]
    a, b = sides(spark, left, right)
    got = {r.i: (r.v, r.k) for r in T.asof_join(
        a, b, "k", "t", "s", ["v"], tie="v", strict=strict, bucket=40,
        tolerance=f"{tolerance} SECOND" if tolerance else None).collect()}
    assert len(got) == len(left)
    for i, (k, t) in enumerate(left):
        fits = [(s, v) for q, s, v in right if q == k and k is not None and s is not None and t is not None
                and (s < t if strict else s <= t)]
        best = max(fits, default=(None, None))
        if best[0] is not None and tolerance and best[0] < t - tolerance:
            best = (None, None)
        assert got[i] == (best[1], k)


def test_asof_null_values_and_empty_sides(spark):
    a, b = sides(spark, [(1, 10), (2, 10)], [(1, 3, 5), (1, 7, None)])
    assert [r.v for r in T.asof_join(a, b, "k", "t", "s", ["v"]).orderBy("i").collect()] == [None, None]
    assert [r.v for r in T.asof_join(a, b.limit(0), "k", "t", "s", ["v"]).collect()] == [None, None]
    assert T.asof_join(a.limit(0), b, "k", "t", "s", ["v"]).collect() == []


def test_asof_cuts_a_hot_key(spark):
    a = spark.range(20_000).select(F.lit(1).alias("k"), F.timestamp_seconds("id").alias("t"))
    b = spark.range(20_000).select(F.lit(1).alias("k"), F.timestamp_seconds("id").alias("s"), F.col("id").alias("v"))
    df = T.asof_join(a, b, "k", "t", "s", ["v"], bucket=1000)
    plan = df._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert df.filter(F.col("v") == F.unix_seconds("t")).count() == 20_000


# --- interval join -----------------------------------------------------------------------

def spans(spark, rows):
    at = lambda t: None if t is None else START + timedelta(seconds=t)
    return spark.createDataFrame([(i, g, at(s), at(e)) for i, (g, s, e) in enumerate(rows)],
                                 "i int, g int, start timestamp, end timestamp")


@pytest.mark.parametrize("keys", [None, ["g"]])
def test_intervals_against_all_pairs(spark, keys):
    rng = random.Random(2)
    def make(n):
        rows = [(rng.randrange(3), s := rng.randrange(-500, 2000), s + rng.choice([0, 1, 7, 60, 61, 400])) for _ in range(n)]
        return rows + [(0, -500, 2500), (1, None, 5), (1, 5, None), (2, 9, 3), (None, 0, 100)]
    left, right = make(60), make(80)
    a, b = spans(spark, left), spans(spark, right)
    df = T.interval_join(a, b, "1 MINUTE", keys)
    assert "NestedLoop" not in df._jdf.queryExecution().toString()
    got = Counter((r.a.i, r.b.i) for r in df.collect())
    want = Counter((i, j) for i, (g, s, e) in enumerate(left) for j, (h, t, f) in enumerate(right)
                   if None not in (s, e, t, f) and s < e and t < f and s < f and t < e
                   and (keys is None or (g is not None and g == h)))
    assert got == want
    with pytest.raises(ValueError):
        T.interval_join(a, b, "0 MINUTE")


@pytest.mark.parametrize("keys", [None, ["g"]])
def test_a_full_cell_is_cut_into_parts(spark, monkeypatch, keys):
    """Each pair is given once, repeated rows too, and the pairs of one cell come from several tasks."""
    monkeypatch.setattr(T, "CELL_ROWS", 20)
    rng = random.Random(5)
    make = lambda n: [(rng.choice([0, 0, 0, 1, None]), s := rng.randrange(0, 60), s + rng.randrange(1, 90)) for _ in range(n)]
    left, right = make(130), make(90)
    a, b = spans(spark, left), spans(spark, right)
    df = T.interval_join(a.drop("i").unionByName(a.drop("i")), b, "1 MINUTE", keys)
    want = Counter((left[i], j) for i, (g, s, e) in enumerate(left) for j, (h, t, f) in enumerate(right)
                   if s < f and t < e and (keys is None or (g is not None and g == h)))
    at = lambda t: int((t - START).total_seconds())
    found = df.select("a", "b", F.spark_partition_id().alias("task")).collect()
    assert Counter(((r.a.g, at(r.a.start), at(r.a.end)), r.b.i) for r in found) == {k: 2 * n for k, n in want.items()}
    tasks = Counter(r.task for r in found if r.a.start < START + timedelta(seconds=60) and r.b.start < START + timedelta(seconds=60))
    assert len(tasks) > 5 and max(tasks.values()) < sum(tasks.values()) / 3


# --- changes -----------------------------------------------------------------------------

def test_changes_are_the_multiset_differences(spark):
    rng = random.Random(9)
    def make(n):
        return [(rng.choice([None, *range(12)]), rng.choice(["a", "b", None]), rng.randrange(2)) for _ in range(n)]
    left, right = make(60), make(60)
    schema = "k int, name string, n_hot int"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    rows = T.changes(a, b, ["k"]).collect()
    x, y = Counter(left), Counter(right)
    assert {(r.k, r.name, r.n_hot): (r.n_before, r.n_after) for r in rows} == {
        r: (x[r], y[r]) for r in x | y if x[r] != y[r]}
    kb, ka = {r[0] for r in left}, {r[0] for r in right}
    assert all(r.change == ("added" if r.k not in kb else "removed" if r.k not in ka else "changed") for r in rows)
    added = T.changes(a.limit(0), b, ["k", "name"]).collect()
    assert {r.change for r in added} == {"added"} and sum(r.n_after for r in added) == 60
    assert T.changes(a, a, ["k"]).collect() == []


def test_rounds_do_not_grow_with_the_number_of_cycles(spark, tmp_path):
    seen = []
    real = W.materialise
    try:
        W.materialise = lambda df, name, work_dir=None: seen.append(name) or real(df, name, work_dir)
        links = [(6 * c + i, 6 * c + (i * 5 + 1) % 6) for c in range(60) for i in range(6)]
        got = order(spark, links, tmp_path)
    finally:
        W.materialise = real
    assert got == walked(links)
    assert seen.count("walk") <= 5
