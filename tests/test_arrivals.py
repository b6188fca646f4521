"""Stop rules and keyed saving: any order, replays and failures between two writes."""

import random

import pytest

from pyspark.sql import functions as F

from pagetables.operators import sequence as Q
from pagetables.streaming import keyed, rules

FACTS = rules.FACTS


def facts(spark, rows):
    return spark.createDataFrame(rows, FACTS)


def run_rows(source, n, empties=(), no_next=(), total=None, start=1):
    return [(hash((source, i)) % 10**9, i, total, i not in no_next, 0 if i in empties else 3, source)
            for i in range(start, start + n)]


def batch_rule(spark, rows, **more):
    df = facts(spark, rows)
    return sorted((r.source, r.page_no) for r in Q.page_set(df, max_pages=more.get("max_pages", 50), run=3).collect())


ROWS = (run_rows("hot", 60, empties=(20, 21, 22), total=60) + run_rows("long", 70, total=70)
        + run_rows("ends", 40, no_next=(31,), total=45) + run_rows("late", 12, start=5)
        + run_rows("gaps", 30, empties=(7, 9, 10, 11), total=30) + [(9, None, None, True, 1, "none")])
ROWS = [r for r in ROWS if not (r[5] == "gaps" and r[1] in (8, 15))]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_gives_the_batch_rules(spark, tmp_path, seed):
    rows = ROWS[:]
    random.Random(seed).shuffle(rows)
    held = rules.StopRules(spark, f"{tmp_path}/state", max_pages=50, empty_run=3)
    seen = []
    for batch, at in enumerate(range(0, len(rows), 60)):
        part = rows[at:at + 60]
        seen += part
        held.add(facts(spark, part), batch)
        if batch == 1:  # the stream failed after the batch and does it again
            held.add(facts(spark, part), batch)
        got = sorted((r.source, r.page_no) for r in held.visited(
            facts(spark, seen).select("source", "page_no")).collect())
        assert got == batch_rule(spark, [r for r in seen if r[1] is not None])
    assert {r.source for r in held.wanted().collect()} == {"late", "gaps"}
    settled = held.current().filter("settled").count()
    assert settled == 3
    # facts of settled runs are not kept any more
    held.add(facts(spark, run_rows("hot", 5, start=61)), 99)
    assert held.facts.read().filter("batch = 99").count() == 0
    assert {r.last_page for r in held.current().filter("source = 'hot'").collect()} == {22}


def test_a_state_read_after_a_restart_goes_on(spark, tmp_path):
    for batch, part in enumerate((ROWS[100:], ROWS[:100])):
        rules.StopRules(spark, f"{tmp_path}/state", max_pages=50, empty_run=3).add(facts(spark, part), batch)
    held = rules.StopRules(spark, f"{tmp_path}/state")
    got = sorted((r.source, r.page_no) for r in held.visited(facts(spark, ROWS).select("source", "page_no")).collect())
    assert got == batch_rule(spark, [r for r in ROWS if r[1] is not None])


# --- keyed saving ------------------------------------------------------------------------

SCHEMA = "k int, text string, captured int"


def table(spark, tmp_path):
    return keyed.KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["k"], "captured", buckets=4)


def content(t):
    return sorted((tuple(r) for r in t.read().collect()), key=repr)


def test_newest_capture_stays_whatever_the_order(spark, tmp_path):
    t = table(spark, tmp_path)
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(20)]), f"text {i}", rng.randrange(8)) for i in range(200)]
    for batch in range(5):
        part = rows[batch * 40:batch * 40 + 40]
        t.merge(spark.createDataFrame(part, SCHEMA), batch)
        best = {}
        for k, text, captured in rows[:batch * 40 + 40]:
            best[k] = max(best.get(k, (-1, "")), (captured, text))
        assert content(t) == sorted(((k, x, c) for k, (c, x) in best.items()), key=repr)
    before = content(t)
    t.merge(spark.createDataFrame([], SCHEMA), 5)
    assert content(t) == before and content(table(spark, tmp_path)) == before


def test_a_replayed_batch_leaves_one_row(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], SCHEMA), 0)
    again = spark.createDataFrame([(1, "c", 2), (3, "d", 2)], SCHEMA)
    for _ in range(3):
        t.merge(again, 1)
    assert content(t) == [(1, "c", 2), (2, "b", 1), (3, "d", 2)]
    t.merge(spark.createDataFrame([(1, "old", 1)], SCHEMA), 2)
    assert content(t) == [(1, "c", 2), (2, "b", 1), (3, "d", 2)]


def test_a_failure_between_rows_and_list_shows_nothing(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(spark.createDataFrame([(k, "first", 1) for k in range(9)], SCHEMA), 0)
    before = content(t)
    write, t.lists.write = t.lists.write, lambda *a: (_ for _ in ()).throw(IOError("lost"))
    new = spark.createDataFrame([(k, "second", 2) for k in range(9)], SCHEMA)
    with pytest.raises(IOError):
        t.merge(new, 1)
    assert content(t) == before
    t.lists.write = write
    t.merge(new, 1)
    assert content(t) == [(k, "second", 2) for k in range(9)]


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(spark.createDataFrame([(k, "first", 1) for k in range(200)], SCHEMA), 0)
    t.merge(spark.createDataFrame([(7, "second", 2)], SCHEMA), 1)
    assert t.rows.read().filter("batch = 1").select("bucket").distinct().count() == 1
    assert t.rows.read().filter(F.col("batch") == 1).count() < 200 and t.read().count() == 200
