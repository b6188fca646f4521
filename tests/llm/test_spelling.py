"""Spelling variants against all edits of all words."""

import re
import zlib
from collections import Counter

import pytest

from pyspark.sql import functions as F

from pagetables.llm import spelling


def brute(rows, divisor=199, least_length=6, least_count=5, ratio=5):
    counts = Counter()
    for doc_id, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for w in re.findall("[a-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % divisor == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1:]
            counts[w] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    letters = sorted({c for w in counts for c in w})
    out, form = {}, {}
    for w, n in counts.items():
        near = {w[:i] + w[i + 1:] for i in range(len(w))}
        near |= {w[:i] + c + w[i + k:] for i in range(len(w) + 1) for c in letters for k in (0, 1)}
        near = sorted((-counts[x], x) for x in near - {w} if x in counts)
        best = near[0] if near and -near[0][0] >= ratio * n else (None, None)
        form[w] = best[1]
        out[w] = (best[1], n, len(near), None if best[0] is None else -best[0])
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (out[w][0], root, *out[w][1:])
    return out


def found(df, **more):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n)
            for r in spelling.variants(df, **more).collect()}


def check(df, **more):
    got = found(df, **more)
    assert got == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], **more)
    return got


def test_variants_of_all_kinds(documents):
    words = {"letter": 400, "leter": 3, "lettter": 20, "letters": 30, "lettar": 60, "lettèr": 9, "lettér": 9,
             "lettary": 11, "aaaaaa": 50, "aaaaaaa": 7, "aaaaaaaa": 300, "étéété": 40, "étèété": 6, "ÉtÉété": 5,
             "xyzxyz": 5, "zyxzyx": 5, "color·our": 9, "colour": 9, "colours": 45, "abcdef×÷": 6, "abcdef×": 40}
    got = check(documents([" ".join([w] * n) for w, n in words.items()] + [None, "", "a b"]))
    assert got["lettar"][0] == "letter" and got["lettary"][:2] == ("lettar", "letter")
    assert got["aaaaaa"][2] == 50 and got["aaaaaa"][0] is None and got["aaaaaaa"][0] == "aaaaaaaa"
    assert got["letter"][3] == sum(w in got for w in ("lettter", "letters", "lettar", "lettèr", "lettér"))


def test_ties_go_to_the_smaller_word(documents):
    got = check(documents([" ".join(["worder"] * 5 + ["wordet"] * 50 + ["wordeé"] * 50 + ["wordea"] * 50)]))
    assert got["worder"][0] == "wordea" and got["worder"][3] == 3


def test_letters_are_taken_out_by_checksum(documents):
    docs = documents([(i, f"Wonderful evening number {i % 7} of the FESTIVAL", "en", "s") for i in range(2000)])
    got = check(docs, divisor=13)
    assert any(v[0] == "wonderful" for v in got.values())


def test_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert len(check(docs)) > 500


def test_long_texts_are_cut_between_words(documents, monkeypatch):
    text = "überlänge straße " * 40
    whole = list(spelling.RUNS.findall(text.lower()))
    for size in (1, 5, 7, 64):
        monkeypatch.setattr(spelling, "SLICE", size)
        assert [w for part in spelling._slices(text) for w in spelling.RUNS.findall(part)] == whole
        assert "".join(spelling._slices(text)) == text
        assert list(spelling._slices("")) == [""]


def test_odd_rows(odd):
    check(odd)
    assert found(odd.limit(0)) == {}
    assert found(odd.filter("text IS NULL")) == {}
    with pytest.raises(ValueError):
        spelling.variants(odd, ratio=1)


def test_groups_are_bounded_by_the_alphabet(spark):
    words = spark.range(3000).select(F.concat(F.lit("word"), F.translate(F.col("id").cast(
        "string"), "0123456789", "abcdefghij")).alias("word"), F.lit(9).cast("bigint").alias("n"))
    rows = spelling.rotations(words)
    assert rows.count() == words.agg(F.sum(2 * F.length("word") + 1)).first()[0]
    top = rows.groupBy("prefix").count().agg(F.max("count")).first()[0]
    assert top <= 11
