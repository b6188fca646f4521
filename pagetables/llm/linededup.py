"""Line de-duplication by pairwise alignment.

Documents that overlap are found through the hashes of their lines. A line, however
frequent, links each document that has it to the first one (by doc_id) that has it, and so
does a line together with the line after it. Every link goes to a first document, so that a
line in n documents makes n - 1 pairs at most, and every document that has such a line is in
a pair. Each pair is aligned with a patience diff on line hashes, and the aligned common
blocks are deleted from the later document. Joins on a line or on a first document are
salted by the later document, so that a line in very many of them is spread over tasks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetables.llm.common import in_arrow, stored

#: Salts of a line, or of a first document, in the joins: the bits of one integer.
SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(text: Column) -> Column:
    """A hash for each line, blanks at its ends aside; null for a blank line."""
    def one(x):
        t = F.trim(x)
        return F.when(t != "", F.xxhash64(t))
    return F.transform(_lines(text), one)


def _longest(order: list[int]) -> list[int]:
    """Places of a longest increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(order)
    for i, x in enumerate(order):
        j = bisect_left(tails, x)
        back[i] = ends[j - 1] if j else -1
        if j == len(tails):
            tails.append(x)
            ends.append(i)
        else:
            tails[j], ends[j] = x, i
    out = []
    i = ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int, int]]:
    """Aligned common blocks ``(start in a, start in b, length)`` of two line sequences.

    Lines that occur once in either range are matched and thinned to the longest sequence
    in order; a match spreads to equal neighbours on both sides; the ranges between are
    aligned in the same way. Equal heads and tails of a range are matched first. Blank
    lines (None) match nothing by themselves but may lie inside a block.
    """
    blocks: list[tuple[int, int, int]] = []
    ranges = [(0, len(a), 0, len(b))]
    while ranges:
        alo, ahi, blo, bhi = ranges.pop()
        n = 0
        while alo + n < ahi and blo + n < bhi and a[alo + n] == b[blo + n]:
            n += 1
        if n:
            blocks.append((alo, blo, n))
            alo, blo = alo + n, blo + n
        n = 0
        while ahi - n > alo and bhi - n > blo and a[ahi - n - 1] == b[bhi - n - 1]:
            n += 1
        if n:
            blocks.append((ahi - n, bhi - n, n))
            ahi, bhi = ahi - n, bhi - n
        if alo >= ahi or blo >= bhi:
            continue
        once: dict = {}
        for i in range(alo, ahi):
            once[a[i]] = -1 if a[i] in once else i
        seen: dict = {}
        for j in range(blo, bhi):
            seen[b[j]] = -1 if b[j] in seen else j
        pairs = [(i, seen[x]) for x, i in once.items()
                 if x is not None and i >= 0 and seen.get(x, -1) >= 0]
        pairs.sort()
        keep = _longest([j for _, j in pairs])
        at, bt = alo, blo
        for i, j in (pairs[p] for p in keep):
            if i < at or j < bt:
                continue  # inside the block of the match before
            s = 0
            while i - s > at and j - s > bt and a[i - s - 1] == b[j - s - 1]:
                s += 1
            e = 1
            while i + e < ahi and j + e < bhi and a[i + e] == b[j + e]:
                e += 1
            blocks.append((i - s, j - s, s + e))
            if keep:
                ranges.append((at, i - s, bt, j - s))
            at, bt = i + e, j + e
        if keep:
            ranges.append((at, ahi, bt, bhi))
    return sorted(blocks)


def _salt(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).cast("int")


def _used(doc_id: str) -> Column:
    """The salts that occur among the documents of a group, a bit for each."""
    return F.bit_or(F.expr(f"shiftleft(1L, pmod(xxhash64({doc_id}), {SALTS}L)::int)"))


def _salts(used: str) -> Column:
    """The salts of ``_used`` as an array."""
    return F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)),
                    lambda i: F.getbit(F.col(used), i) == 1)


def deletions(docs: DataFrame, rare: int | None = None) -> DataFrame:
    """``(doc_id, drop)``: places (from 0) of the lines to delete, for documents with any.

    With ``rare``, a line in more documents than that links only with the line after it. Only the documents' ids and line hashes are shuffled, no text.
    """
    lines = docs.filter(F.col("doc_id").isNotNull()).select(
        "doc_id", line_hashes(F.col("text")).alias("h")).filter(F.size("h") > 0)
    each = lines.select("doc_id", F.posexplode(F.transform("h", lambda x, i: F.struct(
        x.alias("line"), F.when(F.get("h", i + 1).isNotNull(),
                                F.xxhash64(x, F.get("h", i + 1))).alias("two")))).alias("i", "k"))
    each = each.filter(F.col("k.line").isNotNull()).select("doc_id", "k.line", "k.two").distinct()
    each = stored(each, "lines")
    ones = each.select(F.col("line").alias("key"), "doc_id").distinct()
    twos = each.filter(F.col("two").isNotNull()).select(F.col("two").alias("key"), "doc_id")

    def pairs(rows, most=None):
        shared = F.col("n") > 1 if most is None else F.col("n").between(2, most)
        firsts = rows.groupBy("key").agg(
            F.min("doc_id").alias("first"), F.count("doc_id").alias("n"), _used("doc_id").alias("used"))
        firsts = firsts.filter(shared).select("key", "first", F.explode(_salts("used")).alias("salt"))
        return (rows.withColumn("salt", _salt("doc_id")).join(firsts, ["key", "salt"])
                .filter(F.col("doc_id") > F.col("first")).select("doc_id", "first"))

    found = stored(pairs(ones, rare).union(pairs(twos.distinct())).distinct(), "pairs")
    hashes = lines.groupBy("doc_id").agg(F.min("h").alias("h"))  # rows of one doc_id: see below
    wanted = found.groupBy("first").agg(_used("doc_id").alias("used"))
    first = hashes.withColumnsRenamed({"doc_id": "first", "h": "a"}).join(wanted, "first").select(
        "first", "a", F.explode(_salts("used")).alias("salt"))
    both = (found.withColumn("salt", _salt("doc_id")).join(first, ["first", "salt"])
            .join(hashes.withColumnRenamed("h", "b"), "doc_id").select("doc_id", "a", "b"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (in_arrow(both, _aligned, f"doc_id {kind}, line int").distinct()
            .groupBy("doc_id").agg(F.collect_set("line").alias("drop")))


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, lines = [], []
        firsts, laters = batch.column("a"), batch.column("b")
        for i in range(batch.num_rows):
            b = laters[i].as_py()
            for _, start, n in patience(firsts[i].as_py(), b):
                if any(x is not None for x in b[start:start + n]):
                    ids.extend([i] * n)
                    lines.extend(range(start, start + n))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(lines, pa.int32())],
            ["doc_id", "line"])


def dedupe_lines(docs: DataFrame, rare: int | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with the shortened ``text``, and ``lines_removed``,
    ``lines_kept`` (in place of columns of these names).

    A line is deleted if it lies in an aligned common block with an earlier document (a
    smaller doc_id) that it is paired with; the earlier text is the one of the input. Null
    texts stay null, empty and blank texts stay as they are, repeated lines within one
    document stay. Rows with a null doc_id are neither earlier nor later than any other
    and stay whole. Rows that repeat a doc_id are one document: they are not compared with
    each other, and a line to delete goes from each of them at its place in the row with
    the least line hashes. An empty table gives an empty result.
    """
    drop = stored(deletions(docs, rare), "drop").select(
        F.col("doc_id").alias("__id"), F.col("drop").alias("__drop"))
    # a merge join at every size: what is deleted grows with the corpus
    hit = docs.join(drop.hint("merge"), F.col("doc_id") == F.col("__id"), "left")
    lines = _lines(F.col("text"))
    shorter = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__drop", i)), "\n")
    removed = F.coalesce(F.size("__drop"), F.lit(0))
    total = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    return hit.select(
        *(F.when(F.col("__drop").isNull() | F.col("text").isNull(), F.col("text"))
          .otherwise(shorter).alias("text") if c == "text" else F.col(f"`{c}`")
          for c in docs.columns if c not in ("lines_removed", "lines_kept")),
        removed.cast("bigint").alias("lines_removed"),
        (total - removed).cast("bigint").alias("lines_kept"))
