"""Fingerprints, Golay keys and groups against brute force."""

import random

import numpy as np
import xxhash

from pagetables.llm import simhash as S
from pagetables.llm.common import components


def fingerprint(text, n=4):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, bits=4):
    fps = [fingerprint(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, f"{fps[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def ours(df):
    return sorted((tuple(r) for r in S.simhash_groups(df).select(
        "doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_words_at_up_to_five_bits_share_a_key():
    rng = np.random.default_rng(1)
    for bits in range(6):
        a = rng.integers(-2**63, 2**63, 3000, dtype=np.int64)
        b = a.copy()
        for i in range(len(b)):
            for j in rng.choice(64, bits, replace=False):
                b[i] ^= np.int64(np.uint64(1 << int(j)).astype(np.int64))
        ra, ka = S.golay_keys(a)
        rb, kb = S.golay_keys(b)
        keys = set(zip(ra.tolist(), ka.tolist()))
        assert {r for r, k in zip(rb.tolist(), kb.tolist()) if (r, k) in keys} == set(range(len(a)))


def test_golay_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.int64)[::997]
    near = S.codewords(words)
    apart = np.bitwise_count((words ^ (words & 0)).astype(np.uint64))
    assert near.shape == (len(words), 6) and apart.max() <= 23
    assert len(np.unique(S.codewords(np.arange(1 << 12, dtype=np.int64) << 11)[:, 0])) > 1


def test_groups_against_brute_force(documents):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(rng.randrange(1, 120)))
            for _ in range(25)]
    texts = []
    for b in base:
        for _ in range(rng.randrange(1, 6)):
            w = b.split()
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = "Changed"
            texts.append("\t".join(w) if rng.random() < .3 else " ".join(w))
    rng.shuffle(texts)
    rows = [(i * 3, t, "en", "s") for i, t in enumerate(texts)]
    assert ours(documents(rows)) == brute([r[:2] for r in rows])


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert ours(odd) == brute(rows)
    assert S.simhash_groups(odd.limit(0)).count() == 0


def test_long_runs_stay_connected():
    rng = np.random.default_rng(2)
    center = rng.integers(0, 2**62)
    fps = np.unique(np.array([int(center) ^ (1 << int(a)) ^ (1 << int(b)) for a in range(40) for b in range(40)],
                             np.int64))
    far = fps[:7] ^ np.int64(0x3FFF << 48)
    every = np.concatenate([fps, far])
    a, b = S._links(np.zeros(len(every), np.int64), every, 4)
    forest = S._Forest()
    assert len(forest.fresh(a.tolist(), b.tolist())) == len(every) - 2
    assert len(a) < 2 * len(every)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    found = {r.node: r.root for r in components(df).collect()}
    assert found == {**{i: 1 for i in range(2, 41)}, **{i: 100 for i in range(101, 160)}}
