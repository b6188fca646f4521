"""Totals at every level, the filter of known keys, JSON in script blocks."""

from collections import defaultdict
from decimal import Decimal
from itertools import combinations

import pytest

from pyspark.sql import functions as F

from pagetables.operators import embedded, known, rollup

SALES = "a string, b int, v decimal(10,2), who string, level string"
ROWS = [("x" if i % 3 else "hot", None if i % 7 == 0 else i % 4, None if i % 11 == 0 else Decimal(i),
         None if i % 5 == 0 else f"w{i % 23}", "clash") for i in range(300)]


def plain(rows, levels):
    out = {}
    for kept in levels:
        groups = defaultdict(list)
        for r in rows:
            groups[tuple(r[i] if n in kept else None for i, n in enumerate("ab"))].append(r)
        mask = ("a" not in kept) * 2 + ("b" not in kept)
        for key, rs in groups.items():
            vs = [r[2] for r in rs if r[2] is not None]
            out[mask, *key] = (len(rs), sum(vs) if vs else None, len({r[3] for r in rs if r[3] is not None}))
    return out


@pytest.mark.parametrize("levels", ["cube", "rollup", [["b"], []], [["a"]]])
def test_levels(spark, levels):
    df = spark.createDataFrame(ROWS, SALES)
    got = {(r.level, r.a, r.b): (r.n_rows, r.total, r.n_distinct) for r in rollup.level_totals(df, ["a", "b"], "v", "who", levels).collect()}
    sets = {"cube": [c for n in range(3) for c in combinations("ab", n)], "rollup": ["ab", "a", ""]}
    assert got == plain(ROWS, sets[levels] if isinstance(levels, str) else levels)


@pytest.mark.parametrize("exact", [True, False])
def test_an_empty_table_has_a_grand_total_only(spark, exact):
    empty = spark.createDataFrame([], SALES)
    got = rollup.level_totals(empty, ["a", "b"], "v", "who", exact=exact).collect()
    assert [tuple(r) for r in got] == [(3, None, None, 0, None, 0)]
    assert rollup.level_totals(empty, ["a", "b"], "v", "who", [["a"]], exact=exact).count() == 0


def test_sketches_are_near(spark):
    df = spark.range(60000).select((F.col("id") % 3).cast("string").alias("a"), (F.col("id") % 2).alias("b"),
                                   F.lit(1).alias("v"), F.sha2((F.col("id") % 20011).cast("string"), 256).alias("who"))
    exact, sketched = ({(r.level, r.a, r.b): r.n_distinct for r in rollup.level_totals(
        df, ["a", "b"], "v", "who", exact=e).collect()} for e in (True, False))
    assert exact.keys() == sketched.keys() and exact[3, None, None] == 20011
    assert max(abs(sketched[k] / exact[k] - 1) for k in exact) < 0.05


def test_no_level_meets_row_by_row(spark):
    """All three shuffles have partly aggregated rows, and the input is read once."""
    df = spark.createDataFrame(ROWS, SALES)
    plan = rollup.level_totals(df, ["a", "b"], "v", "who", [["a", "b"], ["a"]])._jdf.queryExecution().executedPlan().toString()
    folded = [line for line in plan.splitlines() if "HashAggregate" in line and "partial_sum" in line]
    assert plan.count("Scan ExistingRDD") == 1 and len(folded) == plan.count("Exchange hashpartitioning") == 3


def test_copies_for_the_levels_are_not_shuffled(spark):
    """They are counted where they are made; what is shuffled by level has no distinct value in its key."""
    df = spark.createDataFrame(ROWS, SALES)
    plan = rollup.level_totals(df, ["a", "b"], "v", "who")._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(level" in line]
    assert moved and not [line for line in moved if "_item" in line]


@pytest.mark.parametrize("least", [0, 10])
@pytest.mark.parametrize("levels", ["cube", [["a"], []]])
def test_hot_values_are_counted_once(spark, monkeypatch, least, levels):
    """With 0 all values are hot, or as many as there are bits."""
    rows = ROWS + [("x", i % 4, Decimal(1), "w1", "clash") for i in range(40)] + [(None, 9, None, f"v{i}", "") for i in range(80)]
    monkeypatch.setattr(rollup, "HOT_ROWS", least)
    df = spark.createDataFrame(rows, SALES)
    hot = rollup.hot_values(df, "who", least).collect()
    assert (len(hot) == 63 if least == 0 else 1 < len(hot) < 23) and hot[0] == ("w1", 1) and len({r[1] for r in hot}) == len(hot)
    got = {(r.level, r.a, r.b): (r.n_rows, r.total, r.n_distinct) for r in rollup.level_totals(df, ["a", "b"], "v", "who", levels).collect()}
    assert got == plain(rows, ["ab", "a", "b", ""] if levels == "cube" else ["a", ""])


def test_a_hot_value_is_dealt_to_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(rollup, "HOT_ROWS", 1000)
    df = spark.range(30000).select(F.col("id").alias("_d0"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(
        F.lit("w"), "id")).alias("_item"))
    dealt = rollup._dealt(df, ["_d0"], rollup.hot_values(df, "_item", rollup.HOT_ROWS))
    n = dealt.rdd.getNumPartitions()
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert n > 1 and sum(sizes) == 30000 and max(sizes) < 2 * 30000 / n


KEYS = "id int, k string, n bigint, _maybe string"


def cases():
    rows = [(i, None if i % 10 == 0 else f"k{i % 60}", None if i % 4 == 0 else i % 6, "clash") for i in range(200)]
    held = [(i, f"k{i}", i % 6, "") for i in range(0, 60, 2)] + [(0, None, None, ""), (1, "k1", None, "")] * 3
    return rows, held


@pytest.mark.parametrize("bits", [64, 1 << 10, known.BITS])
def test_anti_join_is_exact_at_every_size(spark, tmp_path, bits):
    rows, held = cases()
    rows, held = [r[:3] for r in rows], [r[:3] for r in held]
    schema = "id int, k string, n bigint"
    got = known.anti_join_known(spark.createDataFrame(rows, schema), spark.createDataFrame(held, schema), ["k", "n"],
                                bits, str(tmp_path)).collect()
    have = {r[1:] for r in held}
    assert sorted(r.id for r in got) == [r[0] for r in rows if r[1:] not in have]


def test_empty_sides_and_repeats(spark, tmp_path):
    schema = "id int, k string"
    some, none = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], schema), spark.createDataFrame([], schema)
    join = lambda a, b: sorted(r.id for r in known.anti_join_known(a, b, ["k"], work_dir=str(tmp_path)).collect())
    assert join(some, none) == [1, 1, 2] and join(none, some) == [] and join(some, some) == []
    with pytest.raises(ValueError):
        known.anti_join_known(some, none, ["k"], bits=100, work_dir=str(tmp_path))


def test_only_doubtful_rows_are_shuffled(spark, tmp_path):
    held = spark.range(20000).select(F.col("id").alias("k"))
    size, hashes = known.filter_size(20000)
    words = known.key_filter(held, ["k"], size, hashes)
    assert words.select(F.size("words")).first()[0] == size // 64
    rows = spark.range(10000, 110000).select(F.col("id").alias("k"))
    seen = known.judged(rows, words, ["k"], size, hashes)
    doubtful = seen.filter("_maybe")
    assert doubtful.filter("k < 20000").count() == 10000
    assert doubtful.count() < 10000 + 0.02 * 90000  # of 90,000 new ones


def blocks(pages, *htmls):
    return embedded.embedded_records(pages(*htmls))


def test_blocks(pages):
    one = '<script type="application/ld+json">{}</script>'
    got = blocks(pages, one.format('{"a": 1}') + "<script>{\"a\": 2}</script>" + one.format('[{"a": 3}, 4, null]'),
                 "<SCRIPT data-x=1 TYPE='application/json'>[]</SCRIPT >", one.format("{bad"), one.format(""), None, "",
                 '<script type="text/plain">{"a": 5}</script>', '<script type=application/json>{"a": 6}').select(
        "page_id", "block_idx", "record_idx", F.to_json("record").alias("j"), "is_bad").collect()
    assert sorted((r.page_id, r.block_idx, r.record_idx, r.j, r.is_bad) for r in got if not r.is_bad) == [
        (1, 1, 1, '{"a":1}', False), (1, 2, 1, '{"a":3}', False), (1, 2, 2, "4", False), (1, 2, 3, "null", False),
        (8, 1, 1, '{"a":6}', False)]
    assert sorted((r.page_id, r.j) for r in got if r.is_bad) == [(3, None), (4, None)]


def test_a_very_long_block(pages):
    text = '{"a": "' + "x<y " * 300000 + '"}'
    got = blocks(pages, f'<script type="application/json">{text}</script>').select(
        F.length(F.try_variant_get("record", "$.a", "string")).alias("n")).collect()
    assert [r.n for r in got] == [1200000]


def test_columns_by_the_schema_found(pages):
    one = '<script type="application/json">{}</script>'
    records = blocks(pages, one.format('[{"id": 1, "p": 1.5, "o": {"x": "y"}, "it\'s": 1}, {"id": 2, "p": "2"}]'),
                     one.format('{"id": 3, "n": null, "o": {"z": true}}'), one.format("{"))
    df = embedded.embedded_columns(records)
    rows = {r.id: r for r in df.select("id", "o.x", "o.z", "`it's`", "n", F.to_json("p").alias("p")).collect()}
    assert rows.keys() == {1, 2, 3}
    assert tuple(rows[1]) == (1, "y", None, 1, None, "1.5") and tuple(rows[2])[1:] == (None, None, None, None, '"2"')
    assert tuple(rows[3])[1:] == (None, True, None, None, None)
    given = embedded.embedded_columns(records, "struct<id: int, p: double>").collect()
    assert sorted((r.id, r.p) for r in given if r.p) == [(1, 1.5), (2, 2.0)]
    assert embedded.embedded_columns(blocks(pages, one.format("4"), one.format('{"a": 1}'))).columns[-1] == "record"
    assert embedded.embedded_columns(blocks(pages, "")).count() == 0
