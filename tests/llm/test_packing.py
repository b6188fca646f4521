"""Packing: every token once, sequences without gaps, the curve without jumps."""

from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from pagetables.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(df, length):
    tokenizer = Tokenizer.from_file(PATH)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    pieces = P.pack(df, PATH, length=length).collect()
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        by_doc[p.doc_id].append(p)
    for s, ps in sequences.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length == len(p.ids) // 4 > 0
            at += p.length
        assert at == length or s == max(sequences) and at < length
    want, got = defaultdict(list), defaultdict(list)
    for d, t in rows:
        want[d].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    for d, ps in by_doc.items():
        ends = sorted(ps, key=lambda p: (p.sequence_id, p.offset))
        ids = []
        for p in ends:  # rows of one doc_id lie one after the other or apart; each is whole
            ids += np.frombuffer(p.ids, "<u4").tolist()
            if p.start + p.length == p.doc_tokens:
                got[d].append(ids)
                ids = []
        assert not ids
    assert {d: sorted(v) for d, v in want.items()} == {d: sorted(v) for d, v in got.items()}


def test_odd_rows(odd):
    check(odd, 2048)
    assert P.pack(odd.limit(0), PATH).count() == 0


def test_texts_that_are_hard_to_cut(documents):
    check(documents(["Don't  stop<|endoftext|>now", "a b c\x1cd", "é ́x", "ΣΑΣ Σ",
                     "İstanbul\t\tx\r\ny", "'s 'LL it's", "1234 5-6_7", "日本語 テキスト", "\x00\x01 x"]), 16)


def test_hilbert_curve_visits_each_cell_by_single_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims), axis=-1).reshape(-1, dims)
        places = P.hilbert(cells, bits)
        assert sorted(places.tolist()) == list(range(side ** dims))
        assert (np.abs(np.diff(cells[np.argsort(places)], axis=0)).sum(axis=1) == 1).all()
