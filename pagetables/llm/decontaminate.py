"""Benchmark decontamination by winnowing, with DataFrame functions only.

A window is ``length`` consecutive words of a benchmark item (a shorter item is one window
of its own length). With k-grams of k words and the least of w consecutive k-gram hashes
kept, where k + w - 1 is the window's length, every window shared by an item and a text has
a kept k-gram in common at the same place: the fingerprint of the text's copy of the window
is that of the item's. Fingerprints of texts meet those of items in a join; each hit is
extended to the windows around it, which meet the items' windows word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetables.llm.common import ascii_lower, stored

#: Words: runs of letters a-z, digits and anything beyond ASCII, once A-Z are lower-cased.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LENGTH = 13
#: Low bits of a fingerprint hold the place of its k-gram.
PLACE = 31


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), BETWEEN_WORDS), "")


def _widen(df: DataFrame, column: str, width: int, join) -> DataFrame:
    """Combine each run of ``width`` neighbours of an array, doubling runs step by step."""
    done = 1
    while done < width:
        step = min(done, width - done)
        df = df.withColumn(column, F.zip_with(
            column, F.slice(column, step + 1, F.greatest(F.size(column), F.lit(1))), join))
        done += step
    return df


def _shape(length: int) -> tuple[int, int]:
    """Words of a k-gram, and k-grams that one is kept of."""
    k = (length + 2) // 2
    return k, length - k + 1


def winnow(df: DataFrame, length: int) -> DataFrame:
    """Add ``prints``: kept k-gram hashes of column ``words``, high bits, and their places,
    low bits. Empty where there are fewer than ``length`` words."""
    k, w = _shape(length)
    df = df.withColumn("prints", F.transform("words", lambda x: F.xxhash64(x)))
    df = _widen(df, "prints", k, lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("prints", F.transform("prints", lambda h, i: F.shiftleft(
        h, PLACE).bitwiseOR(i.cast("bigint"))))
    df = _widen(df, "prints", w, lambda a, b: F.least(a, b))
    return df.withColumn("prints", F.array_distinct(F.slice(
        "prints", 1, F.greatest(F.size("words") - (length - 1), F.lit(0)))))


def _windows(n: int) -> Column:
    """All windows of column ``words``, which has ``n`` words or more, as texts."""
    return F.transform(F.sequence(F.lit(1), F.size("words") - (n - 1)),
                       lambda s: F.array_join(F.slice("words", s, n), " "))


def _lengths(items: DataFrame, length: int) -> list[int]:
    """Window lengths that occur: at most ``length`` values."""
    n = F.least(F.size("words"), F.lit(length))
    return sorted(r[0] for r in items.select(n.alias("n")).filter("n > 0").distinct().collect())


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row for each row of ``docs``: ``row_key, doc_id, n_words, n_hit, items``.

    n_words counts the words of the text, n_hit those inside any occurrence of a window of
    any item, items is the sorted array of ids (as text) of the items with an occurring
    window. A null text has no words. Items that are null or have no words have no window;
    items with one text are all named; rows with a null item_id hit words but are not
    named. Rows of ``docs`` with one doc_id are told apart by a hash of their text; those
    alike in both are alike in the result, and one row is returned for each. Empty tables
    give no hits. Other columns are not read.

    Items' windows are few beside the texts: they are stored, so that their size is known,
    and broadcast by Spark if small, shuffled otherwise. No text is shuffled unless it has
    a hit. A passage in very many texts costs its own windows in each, no pairs of texts.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    items = stored(benchmark.select(F.col("item_id").cast("string").alias("item"),
                                    words(F.col("text")).alias("words"))
                   .filter(F.size("words") > 0), "items")
    found, parts = _lengths(items, length), []
    read = docs.select("doc_id", key.alias("row_key"), words(F.col("text")).alias("words"))
    windows = []
    for n in found:
        of = items.filter(F.size("words") >= length if n == length else F.size("words") == n)
        windows.append(of.select(F.lit(n).alias("n"), "item", F.explode(_windows(n)).alias("window"))
                       .distinct())
        marks = stored(winnow(of, n).select(
            F.explode_outer("prints").alias("p")).select(F.shiftright("p", PLACE).alias("mark"))
            .filter("mark IS NOT NULL").distinct(), "marks")
        _, w = _shape(n)
        place = F.lit((1 << PLACE) - 1)
        # explode_outer: Spark would push the check that an array is not empty below the steps
        # that make it, and so make it twice; a missing fingerprint meets no mark
        hits = (winnow(read, n).select("doc_id", "row_key", F.explode_outer("prints").alias("p"))
                .select("doc_id", "row_key", F.shiftright("p", PLACE).alias("mark"),
                        F.col("p").bitwiseAND(place).cast("int").alias("place"))
                .join(marks, "mark", "left_semi")
                .select("doc_id", "row_key", F.lit(n).alias("n"), F.lit(w).alias("w"), "place"))
        parts.append(hits)
    plain = docs.select("doc_id", key.alias("row_key"), "text")
    n_words = F.size(words(F.col("text")))
    if not parts:
        return plain.select("row_key", "doc_id", n_words.cast("bigint").alias("n_words"),
                            F.lit(0).cast("bigint").alias("n_hit"),
                            F.array().cast("array<string>").alias("items"))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.union(p)
    places = stored(hits.groupBy("doc_id", "row_key").agg(
        F.collect_set(F.struct("n", "w", "place")).alias("places")), "hits")
    known = windows[0]
    for x in windows[1:]:
        known = known.union(x)
    named = stored(known.groupBy("n", "window").agg(
        F.collect_set("item").alias("named")), "windows")

    # windows around the hits, in texts that have any
    some = (plain.join(
        places.withColumnRenamed("doc_id", "d").withColumnRenamed("row_key", "r"),
        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("r")))
        .select("doc_id", "row_key", words(F.col("text")).alias("words"), "places"))
    starts = F.array_distinct(F.flatten(F.transform("places", lambda p: F.transform(
        F.sequence(F.greatest(p["place"] - p["w"] + 1, F.lit(0)), p["place"]),
        lambda s: F.struct(p["n"].alias("n"), s.alias("start"))))))
    starts = F.filter(starts, lambda s: s["start"] + s["n"] <= F.size("words"))
    tried = some.select("doc_id", "row_key", F.explode(F.transform(starts, lambda s: F.struct(
        s["n"].alias("n"), s["start"].alias("start"),
        F.array_join(F.slice("words", s["start"] + 1, s["n"]), " ").alias("window")))).alias("t"))
    spans = tried.select("doc_id", "row_key", "t.*").join(named, ["n", "window"])
    return _summed(plain, spans, n_words)


def _summed(plain: DataFrame, spans: DataFrame, n_words: Column) -> DataFrame:
    per_row = spans.groupBy("doc_id", "row_key").agg(
        F.sort_array(F.collect_set(F.struct("start", "n"))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("named")))).alias("items"))
    # spans in order of their starts: words of each beyond those before it
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    count = F.aggregate("spans", zero, lambda acc, s: F.struct(
        F.greatest(acc["end"], s["start"] + s["n"]).alias("end"),
        (acc["n"] + F.greatest(s["start"] + s["n"] - F.greatest(acc["end"], s["start"]),
                               F.lit(0))).cast("bigint").alias("n")))["n"]
    hit = stored(per_row.select(F.col("doc_id").alias("d"), F.col("row_key").alias("r"),
                                count.alias("n_hit"), "items"), "contaminated")
    return (plain.select("doc_id", "row_key", n_words.cast("bigint").alias("n_words"))
            .join(hit, F.col("doc_id").eqNullSafe(F.col("d"))
                  & (F.col("row_key") == F.col("r")), "left")
            .select("row_key", "doc_id", "n_words",
                    F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def contaminated(n_words: Column, n_hit: Column) -> Column:
    """At least a twentieth of the words is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns unchanged."""
    found = contamination(docs, benchmark)
    out = stored(found.filter(contaminated(F.col("n_words"), F.col("n_hit")))
                 .select(F.col("doc_id").alias("__d"), F.col("row_key").alias("__r"))
                 .distinct(), "removed")
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.join(out, F.col("doc_id").eqNullSafe(F.col("__d")) & (key == F.col("__r")),
                     "left_anti")
