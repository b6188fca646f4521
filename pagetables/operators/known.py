"""Rows that are not in a large set of known ones: a filter of bounded size, then an exact join for what it passes."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetables.sources.tables import materialise

#: Most bits of a filter: 4 MB as it is broadcast, whatever the size of the known set.
BITS = 1 << 25


def filter_size(n: int, bits: int = BITS) -> tuple[int, int]:
    """Bits, a power of two of at least 12 for each of ``n`` values but ``bits`` at most, and the number of hashes."""
    size = min(bits, 1 << max(6, math.ceil(math.log2(max(1, n) * 12))))
    return size, max(1, min(8, round(size / max(1, n) * math.log(2))))


def _places(keys: list[Column], size: int, hashes: int) -> Column:
    """Bits of a key, from two hashes of 32 bits. NULL is a value like any other."""
    both = F.xxhash64(*keys, *(k.isNull() for k in keys))
    low, high = both.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(both, 32).bitwiseOR(F.lit(1))
    return F.array(*((low + i * high).bitwiseAND(F.lit(size - 1)) for i in range(hashes)))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))


def key_filter(known: DataFrame, keys: list[str], size: int, hashes: int) -> DataFrame:
    """One row, ``words``: a Bloom filter of ``size`` bits (a power of two, 64 at least) as an array of 64-bit words.

    The bits of a word are put together by an OR that is partly aggregated before its shuffle; only the words,
    whose number is fixed by ``size``, come together in one row.
    """
    bits = known.select(F.explode(_places([F.col(f"`{k}`") for k in keys], size, hashes)).alias("p"))
    words = bits.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(_bit(F.col("p"))).alias("b"))
    empty = known.sparkSession.range(size // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    every = words.unionByName(empty).groupBy("w").agg(F.bit_or("b").alias("b"))
    listed = F.sort_array(F.collect_list(F.struct("w", "b")))
    return every.groupBy().agg(F.transform(listed, lambda x: x["b"]).alias("words"))


def judged(rows: DataFrame, words: DataFrame, keys: list[str], size: int, hashes: int) -> DataFrame:
    """``rows`` with ``_maybe``: false where the filter rules the key out."""
    def missing(place: Column) -> Column:
        word = F.get("words", F.shiftright(place, 6).cast("int"))
        return word.bitwiseAND(_bit(place)) == 0

    places = _places([F.col(f"`{k}`") for k in keys], size, hashes)
    return rows.join(F.broadcast(words)).withColumn("_maybe", ~F.exists(places, missing)).drop("words")


def anti_join_known(rows: DataFrame, known: DataFrame, keys: list[str], bits: int = BITS,
                    work_dir: str | None = None) -> DataFrame:
    """``rows`` whose ``keys`` are in no row of ``known``; NULLs are equal to each other.

    A filter over the known keys lets rows that are surely new pass without a shuffle; the others, known or taken
    for known by chance, meet the known keys in an exact anti join. The filter has ``bits`` bits at most, a power of two: its
    size changes how many rows are shuffled, never the result. Repeated rows stay; an empty side is fine; other
    columns of ``known`` are not read. The known keys are counted and the filter is stored in the shared
    folder when this is called; ``rows`` are read twice, by narrow scans.
    """
    if bits < 64 or bits & (bits - 1):
        raise ValueError("bits must be a power of two, 64 at least")
    held = known.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)))
    size, hashes = filter_size(held.count(), bits)
    words = materialise(key_filter(held, held.columns, size, hashes), "filter", work_dir)
    seen = judged(rows, words, keys, size, hashes)
    same = reduce(lambda a, b: a & b, (F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
    doubtful = seen.filter("_maybe").join(held.distinct(), same, "left_anti")
    return seen.filter("NOT _maybe").unionByName(doubtful).drop("_maybe")
