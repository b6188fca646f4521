"""Best-fit packing: every token once, no gaps, and no more sequences than the optimum of small cases."""

import random
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagetables.llm import bestfit as B

PATH = public_tokenizers.path("byte_bpe_50k.json")


def placed(plan):
    """Sizes in each sequence, from the runs; checks that places follow without gaps."""
    at = defaultdict(list)
    for size, runs in plan.runs.items():
        total = plan.used[size]
        ends = [r[0] for r in runs[1:]] + [total]
        for (first, sequence, offset, each), end in zip(runs, ends):
            for rank in range(first, end):
                by, k = divmod(rank - first, each)
                at[sequence + by].append((offset + k * size, size))
    for items in at.values():
        here = 0
        for offset, size in sorted(items):
            assert offset == here
            here += size
        assert here <= plan.capacity
    assert set(at) == set(range(plan.sequences))
    return {k: [s for _, s in v] for k, v in at.items()}


def optimum(sizes, capacity):
    """Fewest sequences, by search over rooms."""
    sizes = tuple(sorted(sizes, reverse=True))

    @lru_cache(None)
    def best(i, rooms):
        if i == len(sizes):
            return 0
        s = sizes[i]
        options = [1 + best(i + 1, tuple(sorted(rooms + (capacity - s,))))]
        for r in set(rooms):
            if r >= s:
                rest = list(rooms)
                rest.remove(r)
                options.append(best(i + 1, tuple(sorted(rest + [r - s]))))
        return min(options)
    return best(0, ())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9), st.integers(20, 24))
def test_reduction_keeps_an_optimum(sizes, capacity):
    plan = B.Plan(Counter(sizes), capacity)
    got = placed(plan)
    assert Counter(s for v in got.values() for s in v) == Counter(sizes)
    # what was fixed and the best packing of what was left are an optimum together
    left = [s for k, v in got.items() if k >= plan.fixed for s in v]
    assert plan.fixed + optimum(left, capacity) == optimum(sizes, capacity)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 400), max_size=30))
def test_many_of_each_size_are_as_one_by_one_best_fit(counts):
    plan = B.Plan(dict(counts), 60)
    got = placed(plan)
    assert Counter(s for v in got.values() for s in v) == Counter(counts)
    rest = sorted((s for k, v in got.items() if k >= plan.fixed for s in v), reverse=True)
    rooms = []  # plain best fit in falling order
    for s in rest:
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - s)
        else:
            rooms.append(60 - s)
    assert len(rooms) == plan.sequences - plan.fixed


def test_work_does_not_grow_with_the_counts():
    rng = random.Random(1)
    small = {s: rng.randrange(1, 50) for s in range(1, 2048)}
    large = {s: n * 10 ** 9 for s, n in small.items()}
    a, b = B.Plan(dict(small), 2048), B.Plan(dict(large), 2048)
    assert sum(map(len, b.runs.values())) < 3 * sum(map(len, a.runs.values())) + 10_000
    assert b.sequences <= 1.001 * a.sequences * 10 ** 9
    bound = max(sum(s * n for s, n in small.items()) / 2048, sum(n for s, n in small.items() if s > 1024))
    assert a.sequences <= 1.03 * bound


def check(df, length):
    tokenizer = Tokenizer.from_file(PATH)
    pieces = B.pack(df, PATH, length=length).collect()
    sequences, texts = defaultdict(list), defaultdict(lambda: defaultdict(list))
    for p in pieces:
        sequences[p.sequence_id].append(p)
        texts[p.doc_id][p.piece].append(p)
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length == len(p.ids) // 4 > 0
            at += p.length
        assert at <= length
    want = defaultdict(Counter)
    for r in df.select("doc_id", "text").collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        cuts = [0] * (len(ids) % length > 0) + list(range(len(ids) % length, len(ids), length)) + [len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r.doc_id][k, a, np.array(ids[a:b], "<u4").tobytes()] += 1
    got = {d: Counter((p.piece, p.start, p.ids) for ps in v.values() for p in ps) for d, v in texts.items()}
    assert got == want
    return len(sequences), sum(p.length for p in pieces)


def test_odd_rows(odd):
    for length in (7, 2048):
        check(odd, length)
    assert B.pack(odd.limit(0), PATH).count() == 0


def test_texts_that_are_hard_to_cut(documents):
    check(documents(["Don't  stop<|endoftext|>now", "a b c\x1cd", "é ́x", "ΣΑΣ Σ", "<|endoftext|>",
                     "İstanbul\t\tx\r\n\r\n y", "'s 'LL it's we're", "1234 5-6_7", "日本語 テキスト",
                     "\x00\x01 x", " " * 5000, "x" * 5000, "   　x", "🏳️‍🌈 ½ ² Ⅷ"]), 16)


def test_few_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    sequences, tokens = check(docs, 2048)
    assert sequences <= tokens / 2048 * 1.02 + 1


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_tokens_are_those_of_the_library(text):
    tokens = B._tokens(PATH)
    assert tokens.ranked is not None
    assert tokens.encode(text).tolist() == tokens._whole(text).tolist()
