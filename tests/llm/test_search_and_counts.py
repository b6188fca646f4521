"""Top-k search against brute force; token counts against whole encodings."""

import math
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from pagetables.llm import tokencount as C
from pagetables.llm import topk as T

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "vec_id bigint, embedding array<float>, q string, c string, d string"


def brute(rows, is_query, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in {(i, tuple(v)) for i, v in good if is_query(i)}:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good
                        if j != i and len(w) == len(v))[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    return sorted(out)


def test_top_k_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    grid = lambda n: [rng.randrange(-64, 64) / 64 for _ in range(n)]
    rows = [(i, grid(40), "x", "x", "x") for i in range(300)]
    rows += [(i, rows[i - 300][1], "x", "x", "x") for i in range(300, 340)]
    rows += [(400, None, "", "", ""), (450, [float("nan")] * 40, "", "", ""), (500, [None] * 40, "", "", ""),
             (550, [float("inf")] * 40, "", "", ""), (None, grid(40), "", "", ""), (600, [], "", "", ""),
             (650, [], "", "", ""), (700, grid(3), "", "", ""), (7, rows[7][1], "", "", ""),
             (750, [1e15] * 40, "", "", ""), (10, rows[10][1], "", "", "")]
    rows = [r for r in rows if r[0] != 750]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, lambda i: i % 10 == 0, 5)
    for size in (8192, 60):
        monkeypatch.setattr(T, "CANDIDATES", size)
        monkeypatch.setattr(T, "QUERIES", max(7, size // 8))
        got = sorted(tuple(r) for r in T.top_k(df, F.col("vec_id") % 10 == 0, 5).collect())
        assert got == want


def test_top_k_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in T.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert T.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert T.top_k(df, F.lit(None).cast("boolean")).count() == 0


def test_top_k_beyond_doubles(spark):
    rows = [(0, [2.0 ** 20] * 4), (1, [2.0 ** 20 + 1 / 256] * 4), (2, [2.0 ** 20] * 4)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in T.top_k(df, F.col("vec_id") == 0, 2).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 4 * 2 ** 28 * (2 ** 28 + 1)), (0, 2, 2, 4 * 2 ** 56)]


def encoding():
    return C.ByteTokens(RANKS, public_tokenizers.PATTERN).encoding


def plain(text, rule):
    """Sections by lines; each token's section by bytes held."""
    raw = (text or "").encode()
    parts = [p + b"\n" for p in raw.split(b"\n")]
    owner = [i for i, p in enumerate(parts) for _ in p][:len(raw)]
    counts, crossing = [0] * len(parts), [0] * len(parts)
    at = 0
    enc = encoding()
    for t in enc.encode_ordinary(text or ""):
        mine = owner[at:at + len(enc.decode_single_token_bytes(t))]
        at += len(mine)
        home = mine[0] if rule == "first" else max(sorted(set(mine)), key=lambda s: (mine.count(s), -s))
        counts[home] += 1
        crossing[home] += len(set(mine)) > 1
    return counts, crossing


@pytest.mark.parametrize("rule", C.RULES)
def test_counts_against_plain_version(odd, documents, rule):
    texts = ["a\n\n\nb", "\n\n\n\nx", "x  \n\n  y\n \n \n z\n", "naïve\nΩ≈ç√\n\n😀😀\n日本\n", "\r\n\r\n\r\nend", "one line"]
    for df in (odd, documents(texts)):
        rows = C.section_tokens(df, RANKS, public_tokenizers.PATTERN, rule=rule).collect()
        want = []
        for r in df.collect():
            counts, crossing = plain(r.text, rule)
            at = 0
            for i, p in enumerate((r.text or "").split("\n")):
                end = min(at + len(p) + 1, len(r.text or ""))
                want.append((r.doc_id, i, at, end, counts[i], crossing[i]))
                at = end
        assert sorted((tuple(r) for r in rows), key=repr) == sorted(want, key=repr)
    assert any(r.n_crossing for r in rows)


def test_counts_add_up(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = C.section_tokens(docs, RANKS, public_tokenizers.PATTERN).groupBy("doc_id").agg(
        F.sum("n_tokens").alias("n")).collect()
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=encoding()._mergeable_ranks)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.n == len(enc.encode_ordinary(text[r.doc_id] or "")) for r in rows) and len(rows) == len(text)
    assert C.section_tokens(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
