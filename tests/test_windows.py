"""Event-time windows against a plain version: any cut into batches, replays, late rows, sessions over borders."""

import random
from collections import defaultdict
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from pagetables.streaming.windows import EventWindows, merge_sessions, window_arrivals

START = datetime(2024, 1, 1)
SCHEMA = "k string, at timestamp, v double, start string"
HOUR = timedelta(hours=1)


def batches(seed, n=240, hot=0.4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = START + timedelta(minutes=i * 7 - (rng.randrange(900) if rng.random() < 0.1 else rng.randrange(60)))
        rows.append((None if i % 31 == 0 else "hot" if rng.random() < hot else f"k{rng.randrange(4)}",
                     None if i % 53 == 0 else at, None if i % 17 == 0 else i / 4, "clash"))
    return [rows[i:i + 60] for i in range(0, n, 60)] + [[]]


def plain(parts, width, slide, lateness):
    """Windows with their rows, late rows, and the last mark."""
    kept, late, seen = defaultdict(list), defaultdict(int), None
    for part in parts:
        mark = seen - lateness if seen else None
        for k, at, v, _ in part:
            if at is None:
                late[k, None, None] += 1
                continue
            first = at - (at - START) % slide
            while first + width > at:
                if mark and first + width <= mark:
                    late[k, first, first + width] += 1
                else:
                    kept[k, first, first + width].append(v)
                first -= slide
        seen = max([r[1] for r in part if r[1]] + ([seen] if seen else []), default=None)
    return kept, late, seen - lateness


def totals(rows):
    return {(r.k, r.start, r.end): (r.n, r.total, r.least, r.greatest) for r in rows}


def expected(kept):
    out = {}
    for key, vs in kept.items():
        known = [Decimal(v) for v in vs if v is not None]
        out[key] = (len(vs), sum(known) if known else None, min(known, default=None), max(known, default=None))
    return out


@pytest.mark.parametrize("width,slide", [(1, 1), (6, 2)])
def test_windows_and_late_rows(spark, tmp_path, width, slide):
    parts = batches(width)
    held = EventWindows(spark, str(tmp_path), "at", "v", ["k string"], f"{width} hours", f"{slide} hours", lateness="2 hours")
    frozen = {}
    for n, part in enumerate(parts):
        for _ in range(2 if n == 2 else 1):  # done again after a failure
            held.add(spark.createDataFrame(part, SCHEMA), n)
        now = totals(held.finished().collect())
        assert frozen.items() <= now.items()  # finished windows never change
        frozen = now
    kept, late, mark = plain(parts, width * HOUR, slide * HOUR, 2 * HOUR)
    assert totals(held.current().collect()) == expected(kept)
    assert frozen == {k: v for k, v in expected(kept).items() if k[2] <= mark} and frozen
    assert {(r.k, r.start, r.end): r.n for r in held.late().collect()} == late and len(late) > 3
    if width == slide:
        assert sum(r.n for r in held.current().collect()) + sum(late.values()) == sum(map(len, parts))


def plain_sessions(parts, gap, lateness):
    times, late, seen = defaultdict(list), 0, None
    for part in parts:
        mark = seen - lateness if seen else None
        for k, at, v, _ in part:
            if at is None or (mark and at + gap <= mark):
                late += 1
            else:
                times[k].append(at)
        seen = max([r[1] for r in part if r[1]] + ([seen] if seen else []), default=None)
    out = set()
    for k, ats in times.items():
        run = []
        for at in sorted(ats):
            if run and at > run[-1] + gap:
                out.add((k, run[0], run[-1] + gap, len(run)))
                run = []
            run.append(at)
        out.add((k, run[0], run[-1] + gap, len(run)))
    return out, late


@pytest.mark.parametrize("piece", [None, 3600 * 1000000])
def test_sessions(spark, tmp_path, piece):
    parts = batches(9)
    held = EventWindows(spark, str(tmp_path), "at", "v", ["k string"], gap="20 minutes", lateness="2 hours")
    held.piece = piece or held.piece
    for n, part in enumerate(parts):
        held.add(spark.createDataFrame(part, SCHEMA), n)
    want, late = plain_sessions(parts, HOUR / 3, 2 * HOUR)
    assert {(r.k, r.start, r.end, r.n) for r in held.current().collect()} == want
    assert sum(r.n for r in held.late().collect()) == late > 0


def test_sessions_within_one_another(spark):
    """Equal, touching and nested sessions, and one long one over many pieces."""
    at = lambda m: START + timedelta(minutes=m)
    rows = [("a", at(s), at(e), 1, None, None, None) for s, e in
            [(0, 500), (10, 20), (10, 20), (30, 40), (500, 510), (511, 512), (600, 601)]]
    df = spark.createDataFrame(rows, "k string, start timestamp, end timestamp, n bigint, total decimal(38,6), "
                                     "least decimal(38,6), greatest decimal(38,6)")
    got = {(r.start, r.end, r.n) for r in merge_sessions(df, ["k"], 60 * 1000000).collect()}
    assert got == {(at(0), at(510), 5), (at(511), at(512), 1), (at(600), at(601), 1)}


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    parts = batches(5)[:3]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
        held = EventWindows(spark, f"{tmp_path}/state", "at", "v", width="1 hour", lateness="2 hours")
        arriving = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        window_arrivals(arriving, held, f"{tmp_path}/log").awaitTermination()
    kept, late, _ = plain([[(None, *r[1:]) for r in p] for p in parts], HOUR, HOUR, 2 * HOUR)
    assert {(r.start, r.end): r.n for r in held.current().collect()} == {k[1:]: len(v) for k, v in kept.items()}
    assert {(r.start, r.end): r.n for r in held.late().collect()} == {k[1:]: n for k, n in late.items()}


def test_nothing_arrived_and_odd_arguments(spark, tmp_path):
    held = EventWindows(spark, str(tmp_path), "at", "v", ["k string"], width="1 hour")
    held.add(spark.createDataFrame([], SCHEMA), 0)
    assert held.current().count() == held.late().count() == 0 and held.watermark().first()["mark"] is None
    with pytest.raises(ValueError):
        EventWindows(spark, str(tmp_path), "at", "v")
    with pytest.raises(ValueError):
        EventWindows(spark, str(tmp_path), "at", "v", width="1 hour", gap="1 hour")
