"""Page sequences against brute force, with gaps, small buckets and one large run."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagetables.operators import sequence as Q
from pagetables.plans import listing

SCHEMA = ("source string, page_id bigint, page_no int, n_records int, has_next boolean, "
          "total_pages int")


def facts(spark, runs):
    rows = [(s, i, p, n, nxt, total) for s, pages in runs.items()
            for i, (p, n, nxt, total) in enumerate(pages)]
    return spark.createDataFrame(rows, SCHEMA)


def kept(df):
    out = {}
    for r in df.select("source", "page_no").collect():
        out.setdefault(r["source"], []).append(r["page_no"])
    return {s: sorted(p) for s, p in out.items()}


def visit(pages, max_pages):
    """Walk a run page by page."""
    pages = sorted(pages)
    totals = [t for *_, t in pages if t is not None]
    last = min([max_pages] + ([max(totals)] if totals else []))
    seen, empty = [], 0
    for p, n, nxt, _ in pages:
        if p > last:
            break
        seen.append(p)
        empty = empty + 1 if n == 0 else 0
        if empty >= 3 or not nxt:
            break
    return seen


@pytest.fixture(scope="module")
def runs():
    rng = random.Random(7)
    made = {}
    for s in range(40):
        numbers = sorted(rng.sample(range(1, 40), rng.randint(1, 30)))
        made[f"s{s}"] = [(p, rng.choice([0, 0, 1, 5]), rng.random() < 0.95,
                          rng.choice([None, 25, 60])) for p in numbers]
    made["big"] = [(p, int(p % 1000 != 0 and not 701 <= p <= 703), p != 900, None)
                   for p in range(1, 1001)]
    return made


def test_page_set_is_what_a_walk_visits(spark, runs):
    got = kept(Q.page_set(facts(spark, runs), max_pages=800))
    assert got == {s: visit(p, 800) for s, p in runs.items()}


def test_single_rules(spark, runs):
    df = facts(spark, runs)
    free = {s: [(p, n, True, None) for p, n, *_ in pages] for s, pages in runs.items()}
    assert kept(Q.stop_after_empty_run(df)) == {s: visit(p, 10 ** 6) for s, p in free.items()}
    linked = {s: [(p, 1, nxt, None) for p, _, nxt, _ in pages] for s, pages in runs.items()}
    assert kept(Q.stop_without_next(df)) == {s: visit(p, 10 ** 6) for s, p in linked.items()}
    full = {s: [(p, 1, True, t) for p, _, _, t in pages] for s, pages in runs.items()}
    expected = {s: visit(p, 20) for s, p in full.items()}
    assert kept(Q.page_limit(df, max_pages=20)) == {s: p for s, p in expected.items() if p}


@pytest.mark.parametrize("bucket", [1, 7, 10_000])
def test_running_total_and_positions(spark, runs, bucket):
    df = facts(spark, runs)
    got = Q.running_total(df, "source", "page_no", F.col("n_records"), "t", bucket)
    got = Q.positions(got, bucket=bucket).collect()
    assert len(got) == sum(map(len, runs.values()))
    for r in got:
        earlier = [n for p, n, *_ in runs[r["source"]] if p <= r["page_no"]]
        assert (r["t"], r["pos"]) == (sum(earlier), len(earlier))


def test_outlier_does_not_gather_a_run(spark):
    """200,000 pages and one number far away: buckets stay near their size."""
    limit, bucket = 200_000, 10_000
    df = spark.range(1, limit + 1).select(
        F.lit("s").alias("source"), F.when(F.col("id") == limit, 2_000_000_000).otherwise(
            F.col("id")).cast("int").alias("page_no"))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = Q.in_buckets(df, "source", "page_no", bucket).groupBy("_b").count().collect()
        assert max(r["count"] for r in sizes) < 1.2 * bucket and len(sizes) >= 20
        last = Q.positions(df, bucket=bucket).agg(
            F.max("pos"), F.count_distinct("pos")).first()
        assert tuple(last) == (limit, limit)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_a_row_finds_its_bucket_by_halving(spark):
    """With 1,000 cuts of a source no row looks at all of them, and rows do not move to meet the cuts."""
    n = 50_000
    df = spark.range(n).select(F.when(F.col("id") % 5 > 0, "hot").when(F.col("id") > 99, "warm").otherwise("cold").alias("source"),
                               F.when(F.col("id") != 3, (F.col("id") * 7919 % n / 3).cast("int")).alias("page_no"))
    df = df.unionByName(spark.createDataFrame([(None, 5)], "source string, page_no int"))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = Q.in_buckets(df, "source", "page_no", 40)
        text = got._jdf.queryExecution().executedPlan().toString()
        assert "filter(_cuts" not in text and "SortMergeJoin" not in text
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert len(rows) == n + 1 and {r["_b"] for r in rows if r["source"] in (None, "cold") or r["page_no"] is None} == {0}
    for source, count in (("hot", 1000), ("warm", 250)):
        placed = sorted((r["page_no"], r["_b"]) for r in rows if r["source"] == source and r["page_no"] is not None)
        assert [b for _, b in placed] == sorted(b for _, b in placed)  # a bucket is a range
        assert len(dict(placed)) == len(set(placed))  # a number is in one bucket
        assert count * 0.95 <= len({b for _, b in placed}) <= count


def test_stored_pages_all_come_back(spark):
    """Without a rule nothing is left out: no page without a number, none beyond fifty."""
    html = "<table><tr><th>Owner<tr><td>O{0}<td>b<td>c</table>"
    pages = spark.createDataFrame(
        [(i, f"http://a.t/{i}", html.format(i), "s", None if i % 2 else i) for i in range(1, 121)],
        "page_id bigint, url string, html string, source string, page_no int")
    got = listing.run_listing(pages, "2024-01-02 03:04:05").collect()
    assert sorted(r["page_number"] for r in got) == list(range(1, 121))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 2), min_size=1, max_size=25))
def test_empty_run_keeps_a_prefix(spark, counts):
    df = facts(spark, {"s": [(i, n, True, None) for i, n in enumerate(counts, 1)]})
    got = kept(Q.stop_after_empty_run(df))["s"]
    assert got == list(range(1, len(got) + 1))
    assert got == visit([(i, n, True, None) for i, n in enumerate(counts, 1)], 10 ** 6)


def test_page_numbers(spark):
    df = spark.createDataFrame([("0",), ("1",), ("1000",), ("1001",), ("x",)], "t string")
    assert [r[0] for r in df.select(Q.page_number_range(F.col("t"))).collect()] == [
        None, 1, 1000, None, None]


def test_page_without_number_gets_its_position(spark):
    rows = [(10, "http://a.t/", "s", "<p>"), (30, "http://a.t/?page=9", "s", "<p>"),
            (20, "http://a.t/", "s", "<p>"), (5, "http://a.t/", "r", "<p>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, source string, html string")
    got = Q.current_page(df, source="source").collect()
    assert {r["page_id"]: r["page_no"] for r in got} == {10: 1, 20: 2, 30: 9, 5: 1}


def test_run_listing_numbers_pages_that_show_no_number(spark):
    """Runs come out whole when pages carry no page number; ids may lie far apart."""
    html = "<table><tr><th>Owner<tr><td>O{0}<td>b<td>c</table><a href=n>Next</a>"
    ids = [-(2 ** 62), -5, 3, 2 ** 62]
    pages = spark.createDataFrame(
        [(i, f"http://a.t/{i}", html.format(n), "s") for n, i in enumerate(ids)],
        "page_id bigint, url string, html string, source string")
    got = listing.run_listing(pages, "2024-01-02 03:04:05").collect()
    assert sorted((r["page_number"], r["owner_name"]) for r in got) == [
        (1, "O0"), (2, "O1"), (3, "O2"), (4, "O3")]
