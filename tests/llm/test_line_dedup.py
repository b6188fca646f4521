"""Line de-duplication: the alignment, and the whole operator against a plain version."""

import random
from collections import defaultdict

from pagetables.llm import linededup as L


def plain(rows, rare):
    """The documented rule, by dictionaries."""
    lines = {d: [x.strip(" ") or None for x in (t or "").split("\n")] for d, t in rows if d is not None}
    ones, twos = defaultdict(set), defaultdict(set)
    for d, ls in lines.items():
        for i, x in enumerate(ls):
            if x is not None:
                ones[x].add(d)
                if i + 1 < len(ls) and ls[i + 1] is not None:
                    twos[x, ls[i + 1]].add(d)
    pairs = {(d, min(ds)) for ds in ones.values() if 2 <= len(ds) <= rare for d in ds}
    pairs |= {(d, min(ds)) for ds in twos.values() if len(ds) > 1 for d in ds}
    drop = defaultdict(set)
    for d, first in pairs:
        if d > first:
            for _, s, n in L.patience(lines[first], lines[d]):
                if any(x is not None for x in lines[d][s:s + n]):
                    drop[d] |= set(range(s, s + n))
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop[d])
            if drop[d] else t for d, t in rows if d is not None}


def test_against_plain_version(documents):
    rng = random.Random(8)
    common = [f"boilerplate {i}" for i in range(3)]
    shared = [[f"shared {k} {i}" for i in range(rng.randrange(1, 6))] for k in range(8)]
    rows = []
    for d in range(80):
        ls = [f"own {d} {i}" for i in range(rng.randrange(0, 4))]
        for _ in range(rng.randrange(0, 3)):
            ls[rng.randrange(len(ls) + 1):0] = rng.choice(shared)
        ls.insert(0, rng.choice(common))
        if rng.random() < .3:
            ls.insert(rng.randrange(len(ls)), "  ")
        rows.append((d, "\n".join(ls), "en", "s"))
    rows += [(200, rows[3][1], "en", "s"), (201, rows[3][1] + "\nmore", "en", "s")]
    for rare in (5, 100):
        got = {r.doc_id: r.text for r in L.dedupe_lines(documents(rows), rare).collect()}
        assert got == plain([r[:2] for r in rows], rare)


def test_frequent_line_alone_stays(documents):
    rows = [(i, f"header\nown {i}", "en", "s") for i in range(20)]
    kept = L.dedupe_lines(documents(rows), rare=10).collect()
    assert all(r.text.startswith("header\n") and r.lines_removed == 0 for r in kept)


def test_line_of_very_many_documents_goes(documents):
    rows = [(i, f"own {i}\nfooter\nmore {i}", "en", "s") for i in range(300)]
    kept = {r.doc_id: r.text for r in L.dedupe_lines(documents(rows)).collect()}
    assert kept == {i: f"own {i}\nfooter\nmore {i}" if i == 0 else f"own {i}\nmore {i}" for i in range(300)}
    assert kept == plain([r[:2] for r in rows], len(rows))


def test_odd_rows(odd):
    kept = L.dedupe_lines(odd)
    assert kept.columns == odd.columns + ["lines_removed", "lines_kept"]
    got = sorted(((r.doc_id, r.text, r.lines_removed, r.lines_kept) for r in kept.collect()), key=repr)
    text = {r.doc_id: r.text for r in odd.collect()}
    assert len(got) == odd.count()
    for d, t, removed, left in got:
        if d == 6:
            assert (t, removed, left) == ("", 1, 0)
        elif d is not None:
            assert t == text[d] and removed == 0
    assert L.dedupe_lines(odd.limit(0)).count() == 0


def test_patience_blocks():
    assert L.patience(list("abcdef"), list("xbcdyef")) == [(1, 1, 3), (4, 5, 2)]
    assert L.patience([], list("ab")) == [] and L.patience(list("ab"), []) == []
    assert L.patience(list("aaaa"), list("aa")) == [(0, 0, 2)]
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randrange(12) for _ in range(rng.randrange(15))]
        b = [rng.randrange(12) for _ in range(rng.randrange(15))]
        at = bt = 0
        for i, j, n in L.patience(a, b):
            assert i >= at and j >= bt and a[i:i + n] == b[j:j + n]
            at, bt = i + n, j + n
