"""Removal of repeated word sequences against brute force, and the suffix automaton."""

import random

from pagetables.llm import substring as S


def split(text):
    w = text or ""
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    return [x for x in w.split(" ") if x]


def brute(rows, length):
    seen, out = {}, []
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = split(t)
        gone = set()
        for s in range(len(w) - length + 1):
            k = tuple(w[s:s + length])
            if seen.setdefault(k, (d, s)) != (d, s):
                gone |= set(range(s, s + length))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    out += [(None, len(w), 0, " ".join(w)) for d, t in rows if d is None for w in [split(t)]]
    return sorted(out, key=repr)


def ours(df, **kw):
    return sorted((tuple(r) for r in S.remove_repeats(df, **kw).select(
        "doc_id", "n_words", "n_removed", "kept").collect()), key=repr)


def corpus(seed, words=40, n=60):
    rng = random.Random(seed)
    text = lambda k: [f"w{rng.randrange(words)}" for _ in range(k)]
    shared = [text(rng.randrange(5, 40)) for _ in range(6)]
    rows = []
    for i in range(n):
        w = text(rng.randrange(0, 30))
        for _ in range(rng.randrange(0, 4)):
            s = rng.choice(shared)
            w += s[rng.randrange(0, 4):] + text(rng.randrange(0, 10))
        rows.append((i * 2, (" " if rng.random() < .5 else "\n").join(w), "en", "s"))
    rows.append((1, " ".join(["again"] * 90), "en", "s"))
    rows.append((3, " ".join(["a", "b", "c"] * 40), "en", "s"))
    rows.append((500, rows[10][1], "en", "s"))
    rng.shuffle(rows)
    return rows


def test_against_brute_force(documents):
    for length in (20, 7, 1):
        rows = corpus(length)
        assert ours(documents(rows), length=length) == brute([r[:2] for r in rows], length)


def test_split_anchors_give_the_same(documents):
    rows = corpus(9, words=6, n=40)
    assert ours(documents(rows), length=8, shard=3) == brute([r[:2] for r in rows], 8)


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    once = list(dict.fromkeys(rows))
    found = ours(odd)
    assert len(found) == len(rows)
    assert sorted(set(found), key=repr) == sorted(set(brute(once, 20)), key=repr)
    assert S.remove_repeats(odd.limit(0)).count() == 0


def test_automaton_statistics():
    rng = random.Random(4)
    for _ in range(60):
        seqs = [[rng.randrange(3) for _ in range(rng.randrange(1, 25))] for _ in range(4)]
        a = S.SuffixAutomaton()
        for s in seqs:
            a.add(s)
        runs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        q = [rng.randrange(4) for _ in range(30)]
        best = [max([0] + [n for n in range(1, i + 2) if tuple(q[i + 1 - n:i + 1]) in runs])
                for i in range(len(q))]
        assert a.statistics(q) == best
