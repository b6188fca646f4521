"""Spelling variants: words one edit apart, by permuterm rotations.

A word is closed with a terminator and rotated in every way. Two words that differ by one
replaced letter have rotations that end with it and are equal before it; the rotation of a
word from which a letter was deleted is the longer word's rotation without its last letter.
So near words are neighbours in the sorted rotations: those that share the prefix before the
last, edited character. The rotations are range-sorted by that prefix and scanned group by
group. A group has one word for each skipped letter and one for none, all of which are near
each other, so its best neighbours and their numbers need no pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.llm.common import by_text, in_arrow, stored

#: Runs of letters: A-Z are lower-cased before.
RUNS = re.compile("[a-zÀ-ÿ]+")
MARK = "$"
#: Distinct words that a task counts before it hands them on.
HELD = 100_000
#: Characters of a text that are looked at together.
SLICE = 1 << 20


def _slices(text: str) -> Iterator[str]:
    """A text in slices that do not cut a run of letters."""
    at = 0
    while len(text) - at > SLICE:
        end = at + SLICE
        while end < len(text) and RUNS.match(text[end]):
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def word_counts(docs: DataFrame, divisor: int = 199, least_length: int = 6) -> DataFrame:
    """``(word, n)``: occurrences of all words of at least ``least_length`` code points.

    A word is a maximal run of letters, A-Z lower-cased. Where ``divisor`` divides the
    crc32 of ``<doc_id>:<word>``, its code point at that number modulo the length is taken
    out; a null doc_id is written as nothing. Tasks count by themselves before the shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                ["word", "n"])

        for batch, texts in by_text(batches):
            ids = batch.column("id").to_pylist()
            for name, text in zip(ids, texts):
                start = zlib.crc32(f"{name or ''}:".encode())
                for part in _slices((text or b"").lower().decode("utf-8")):
                    for word, n in Counter(RUNS.findall(part)).items():
                        h = zlib.crc32(word.encode(), start)
                        if h % divisor == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                        if len(word) >= least_length:
                            held[word] = held.get(word, 0) + n
                    if len(held) >= HELD:
                        yield out()
                        held = {}
        yield out()

    counted = in_arrow(docs.select(F.col("doc_id").cast("string").alias("id"), "text"), run,
                       "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """``(prefix, skipped, word, n, first)``: each rotation of a terminated word that ends
    with a letter, cut before it, and each whole rotation, with nothing skipped. ``first``:
    the skipped letter is not the one before it again (taking out either gives one word)."""
    w, i = F.col("word"), F.col("i")
    at = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"))
    before = F.substring(w, F.lit(1), i)
    whole = F.concat(F.substring(w, i + 1, F.length(w)), F.lit(MARK), before)
    cut = F.concat(F.substring(w, i + 2, F.length(w)), F.lit(MARK), before)
    letter = F.substring(w, i + 1, F.lit(1))
    last = F.substring(w, i, F.lit(1))
    uncut = F.struct(whole.alias("prefix"), F.lit("").alias("skipped"), F.lit(True).alias("first"))
    skips = F.struct(cut.alias("prefix"), letter.alias("skipped"),
                     ((i == 0) | (letter != last)).alias("first"))
    rows = F.when(i < F.length(w), F.array(uncut, skips)).otherwise(F.array(uncut))
    return at.select("word", "n", F.explode(rows).alias("r")).select(
        "r.prefix", "r.skipped", "r.first", "word", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """``(word, n_near, best, best_n)`` for each word that has near ones: their number and the
    most frequent of them, ties to the smallest."""
    ranged = rotations(words).repartitionByRange("prefix").sortWithinPartitions("prefix", "skipped")
    member = F.struct((-F.col("n")).alias("order"), "word", "skipped", "first")
    groups = ranged.groupBy("prefix").agg(F.array_sort(F.collect_list(member)).alias("g")).filter(
        F.size("g") > 1)  # one word for each letter at most, and one without
    g = F.col("g")
    cut = F.filter(g, lambda m: m["skipped"] != "")
    groups = groups.select(
        g, F.size(cut).alias("cut"), F.exists(g, lambda m: m["skipped"] == "").alias("whole"),
        F.size(F.filter(cut, lambda m: m["first"])).alias("firsts"))
    each = groups.select(F.explode(F.transform(g, lambda m: F.struct(
        m["word"].alias("word"),
        F.when(m["skipped"] == "", F.col("firsts"))
        .otherwise(F.col("cut") - 1 + (F.col("whole") & m["first"]).cast("int")).alias("near"),
        F.when(g[0]["word"] == m["word"], g[1]).otherwise(g[0]).alias("other")))).alias("e"))
    return each.groupBy("e.word").agg(
        F.sum("e.near").cast("bigint").alias("n_near"),
        F.min(F.struct("e.other.order", "e.other.word")).alias("best")).select(
            "word", "n_near", F.col("best.word").alias("best"), (-F.col("best.order")).alias("best_n"))


def variants(docs: DataFrame, divisor: int = 199, least_length: int = 6, least_count: int = 5,
             ratio: int = 5) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for each word of at least ``least_length``
    code points that occurs at least ``least_count`` times.

    Near words differ by exactly one inserted, deleted or replaced code point. A word's
    form is its most frequent near word (ties: the smallest in code-point order) if that
    one occurs at least ``ratio`` times as often, else null; root is the last form on the
    way from form to form, the word itself if it has none. Null and empty texts have no
    words; repeated rows count each; a null doc_id is written as nothing in the checksum.
    An empty table gives no rows. Other columns are not read.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2, so that forms cannot lead back")
    words = stored(word_counts(docs, divisor, least_length).filter(F.col("n") >= least_count), "words")
    found = neighbours(words)
    good = F.col("best_n") >= ratio * F.col("n")
    named = stored(words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")), "forms")
    # the way of each word with a form, twice as far in each round
    way = stored(named.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "way")
    while True:
        on = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        far = stored(way.join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "way")
        way = far.select("word", "root")
        if far.filter("moved").isEmpty():
            break
    return named.join(way, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
