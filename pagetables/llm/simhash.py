"""Near-duplicates by SimHash fingerprints, found through Golay codewords.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The binary Golay code of
length 23 is perfect: each 23-bit word has one codeword within 3 bits, and 5 more at 4 bits
where the nearest is 3 bits away. Two words that differ in up to 2 bits share a codeword
within 4 bits (the one nearest to a word half-way), so these 1 or 6 codewords are the keys
of a segment. Fingerprints that differ in up to 5 bits have two segments with at most 2
errors each: the keys of a fingerprint are all pairs of codewords for each pair of its
segments, 24 bits each. Candidates that share a key are verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.llm.common import by_text, components, in_arrow, stored

SEGMENTS = ((0, 23), (23, 23), (46, 18))
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
MOST_BITS = 5
#: Runs of one key up to this length are compared pair by pair at once.
SHORT_RUN = 64


def _fingerprint(text: bytes | None, shingle: int) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    else:
        starts = np.concatenate(([0], ends[:-1] + 1))
        h = xxhash.xxh64_intdigest
        hashes = np.array([h(line[s:e], 42) for s, e in
                           zip(starts[:len(words) - shingle + 1].tolist(),
                               ends[shingle - 1:].tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at:at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``(doc_id, fp)`` for each row of ``docs``; a null or wordless text has fingerprint 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_text(batches):
            fps = pa.array([_fingerprint(t, shingle) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fps], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, fp bigint")


def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits; for each syndrome the errors of up to
    4 bits that lead to a codeword (the nearest one repeated where there is no other)."""
    unit = []
    for i in range(23):
        x = 1 << i
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GENERATOR << (bit - 11)
        unit.append(x)

    def table(first: int, n: int) -> np.ndarray:
        out = np.zeros(1 << n, np.int32)
        for j in range(n):
            out[1 << j:2 << j] = out[:1 << j] ^ unit[first + j]
        return out

    low, high = table(0, 12), table(12, 11)
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            word = sum(1 << i for i in bits)
            found[low[word & 4095] ^ high[word >> 12]].append(word)
    errors = np.array([(f + [f[0]] * 6)[:6] for f in found], np.int64)
    return low, high, errors


_TABLES: list = []


def codewords(words: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords within 4 bits of each 23-bit word, 6 a row."""
    if not _TABLES:
        _TABLES.extend(_golay())
    low, high, errors = _TABLES
    near = words[:, None] ^ errors[low[words & 4095] ^ high[words >> 12]]
    return near >> 11


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys, each key of a row once."""
    u = fps.view(np.uint64)
    near = [codewords(((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64))
            for at, n in SEGMENTS]
    keys = np.concatenate([((p << 24) | (near[i][:, :, None] << 12) | near[j][:, None, :])
                           .reshape(len(u), 36)
                           for p, (i, j) in enumerate(combinations(range(3), 2))], axis=1)
    keys.sort(axis=1)
    fresh = np.ones(keys.shape, bool)
    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return np.repeat(np.arange(len(u)), fresh.sum(axis=1)), keys[fresh]


def _apart(a, b):
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))


class _Forest:
    """Keeps an edge only if it joins what the task has not joined before."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def fresh(self, a: list[int], b: list[int]) -> list[tuple[int, int]]:
        out = []
        for x, y in zip(a, b):
            r, s = self.root(x), self.root(y)
            if r != s:
                self.up[max(r, s)] = min(r, s)
                out.append((x, y))
        return out


def _links(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among fingerprints with one key: all of them in short runs, in long
    runs those that join what no earlier link of the run joins (a walk from fingerprint to
    fingerprint over the ones not reached yet)."""
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
    size = ends - starts
    some = np.repeat((size > 1) & (size <= SHORT_RUN), size)
    k, f = keys[some], fps[some]
    left, right = [], []
    for lag in range(1, SHORT_RUN):
        if lag >= len(k):
            break
        same = np.flatnonzero(k[lag:] == k[:-lag])
        if not len(same):
            break
        hit = same[_apart(f[same + lag], f[same]) <= bits]
        left.append(f[hit])
        right.append(f[hit + lag])
    for i in np.flatnonzero(size > SHORT_RUN):
        rest = fps[starts[i]:ends[i]]
        queue: list[np.ndarray] = []
        while len(rest):
            if queue:
                pivot = queue.pop()
            else:
                pivot, rest = rest[:1], rest[1:]
            near = _apart(rest, np.broadcast_to(pivot, rest.shape).copy()) <= bits
            if near.any():
                reached = rest[near]
                left.append(np.repeat(pivot, len(reached)))
                right.append(reached)
                queue.extend(reached[j:j + 1] for j in range(len(reached)))
                rest = rest[~near]
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def links(distinct: DataFrame, bits: int) -> DataFrame:
    """Links ``(a, b)`` that join all fingerprints of column ``fp`` with up to ``bits``
    differing bits. Not every such pair is listed: among those of one task, a pair that
    earlier pairs join already is left out."""
    if not 0 <= bits <= MOST_BITS:
        raise ValueError(f"bits must be from 0 to {MOST_BITS}")

    def keyed(batches):
        for batch in batches:
            fps = np.asarray(batch.column("fp"))
            for at in range(0, len(fps), 4096):
                part = fps[at:at + 4096]
                rows, keys = golay_keys(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.astype(np.int32)), pa.array(part[rows])], ["key", "fp"])

    def joined(batches):
        forest = _Forest()
        keys, fps = [], []

        def out(k, f):
            a, b = _links(k, f, bits)
            edges = forest.fresh(a.tolist(), b.tolist())
            return pa.RecordBatch.from_arrays(
                [pa.array([e[0] for e in edges], pa.int64()),
                 pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])

        for batch in batches:  # a run of one key may go on in the next batch
            k, f = np.asarray(batch.column("key")), np.asarray(batch.column("fp"))
            if not len(k):
                continue
            last = np.searchsorted(k, k[-1])
            if last == 0 and keys and keys[-1][-1] == k[-1]:
                keys.append(k)
                fps.append(f)
                continue
            yield out(np.concatenate([*keys, k[:last]]), np.concatenate([*fps, f[:last]]))
            keys, fps = [k[last:]], [f[last:]]
        if keys:
            yield out(np.concatenate(keys), np.concatenate(fps))

    rows = in_arrow(distinct.select("fp"), keyed, "key int, fp bigint")
    return in_arrow(rows.repartition("key").sortWithinPartitions("key"), joined,
                    "a bigint, b bigint")


def simhash_groups(docs: DataFrame, shingle: int = 4, bits: int = 4) -> DataFrame:
    """Groups of near-duplicates among all texts.

    Returns one row ``(doc_id, fingerprint, component_id)`` for each row of ``docs``:
    fingerprint as 16 hexadecimal digits, component_id the smallest doc_id reachable over
    links of at most ``bits`` differing bits. Null, empty and blank texts have fingerprint
    zero and are linked like any other; a text of fewer than ``shingle`` words is one
    shingle. Rows with one doc_id are separate rows with one name. A null doc_id is kept
    and never the smallest. An empty table gives an empty result. Other columns of
    ``docs`` are not read.

    Equal fingerprints are one node, so exact copies cost no pairs; only the last join, on
    the fingerprint, sees them again, and Spark may split it.
    """
    fps = stored(fingerprints(docs, shingle), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(nodes, bits))
    nodes = (nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
             .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = nodes.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
