"""Removal of word sequences that repeat earlier ones, by suffix automata.

A window is ``length`` consecutive words. Every window is kept by one anchor: the least
hash among the runs of words of a fixed shorter length inside it, the leftmost if equal, so
that equal windows have equal anchors at the same place. The windows of an anchor are one
passage of a document. Anchors that occur twice or more route passages to reference shards.
Passages that are equal as a whole are one passage with several places, of which all but the
first go; a shard holds the different passages around one anchor, in the order of the corpus.
It builds a suffix automaton of the passages seen so far and streams the next one through it;
where the matching statistic reaches ``length``, a window occurs earlier.

A corpus of references is too large to be broadcast, so passages are sent to the automata
that can match them instead of all automata to all tasks. An anchor with very many different
passages is too much for one automaton; its passages are taken apart into windows, the
shortest passages there are, and what is equal as a whole is found as above.

Texts are hashed once. A task hands on one row for each anchor of a stretch of text with all
places of it, so that a frequent anchor is a few rows of each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetables.llm.common import by_text, in_arrow, stored

LENGTH = 20
#: Different passages that one shard takes before its anchor is split by window.
SHARD = 2000
#: Words of the runs that anchors are chosen from, of those of a window.
RUN_SHARE = 0.3
#: Passages of a task that are put together by anchor.
STRETCH = 200_000
#: Distinct words whose hashes a task remembers.
REMEMBERED = 200_000
#: Low bits hold a place while the least hash of a window is looked for.
PLACE = np.uint64(28)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _runs(h: np.ndarray, width: int, join) -> np.ndarray:
    """Combine each run of ``width`` neighbours, doubling runs step by step."""
    done = 1
    while done < width:
        step = min(done, width - done)
        h = join(h[:-step], h[step:], step)
        done += step
    return h


def _chained(a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    x = (a + np.uint64(step)) * np.uint64(0x9E3779B97F4A7C15) ^ (b >> np.uint64(29))
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + b


def anchors(hashes: np.ndarray, ends: np.ndarray, length: int
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of each passage; ``ends`` are the ends of
    the documents whose word hashes lie end to end."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(hashes) < length:
        return none
    words = max(1, int(length * RUN_SHARE))
    grams = _runs(hashes, words, _chained)
    packed = (grams >> PLACE << PLACE) | np.arange(len(grams), dtype=np.uint64)
    least = _runs(packed, length - words + 1, lambda a, b, _: np.minimum(a, b))
    starts = np.arange(len(least))
    inside = starts + length <= ends[np.searchsorted(ends, starts, side="right")]
    starts = starts[inside]
    if not len(starts):
        return none
    at = (least[inside] & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    n = np.diff(np.append(new, len(starts)))
    return grams[at[new]], starts[new], n


class SuffixAutomaton:
    """Suffix automaton of several word sequences, built online."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.len = [0]

    def add(self, words: list) -> None:
        last = 0
        nxt, link, length = self.next, self.link, self.len
        for w in words:
            q = nxt[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is None:
                cur = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                p = last
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][w]
                    link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
                last = cur
            else:
                last = self._split(last, w, q)

    def _split(self, p: int, w, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    def statistics(self, words: list) -> list[int]:
        """For each word the length of the longest match that ends with it."""
        nxt, link, length = self.next, self.link, self.len
        at = n = 0
        out = []
        for w in words:
            while at and w not in nxt[at]:
                at = link[at]
                n = length[at]
            if w in nxt[at]:
                at = nxt[at][w]
                n += 1
            out.append(n)
        return out


_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def digests(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each run of words from ``start`` to ``end``, alike for equal runs: a
    polynomial in the word hashes, from running sums."""
    n = len(hashes)
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _FACTOR))))
    back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _INVERSE))))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(hashes * powers[:-1])))
    d = (sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64)
    return (d ^ (d >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)


def _by_anchor(anchor: np.ndarray, places: pa.StructArray) -> pa.RecordBatch:
    """One row for each anchor: its first place, and the list of the others."""
    order = np.argsort(anchor, kind="stable")
    anchor = anchor[order]
    new = np.concatenate(([True], anchor[1:] != anchor[:-1]))
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(anchor)))
    offsets = np.concatenate(([0], np.cumsum(times - 1)))
    head = places.take(pa.array(order[first]))
    more = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)),
                                    places.take(pa.array(order[~new])))
    return pa.RecordBatch.from_arrays(
        [pa.array(anchor[first].view(np.int64)), pa.array(times.astype(np.int32)), *head.flatten(), more],
        ["anchor", "times", "doc_id", "start", "n", "digest", "more"])


def _passages(docs: DataFrame, length: int) -> DataFrame:
    """``(anchor, times, doc_id, start, n, digest, more)``: the passages of each stretch of
    text, by anchor; the first one in columns, the others as a list of structs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        anchors_, places, held = [], [], 0
        for batch, texts in by_text(batches):
            words = [(t or b"").split() for t in texts]
            ends = np.cumsum([len(w) for w in words], dtype=np.int64)
            flat = np.fromiter((known[x] for w in words for x in w), np.uint64, int(ends[-1]))
            anchor, start, n = anchors(flat, ends, length)
            if not len(anchor):
                continue
            row = np.searchsorted(ends, start, side="right")
            begin = ends[row] - np.array([len(w) for w in words], np.int64)[row]
            places.append(pa.StructArray.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array((start - begin).astype(np.int32)),
                 pa.array(n.astype(np.int32)),
                 pa.array(digests(flat, start, start + n + length - 1).view(np.int64))],
                ["doc_id", "start", "n", "digest"]))
            anchors_.append(anchor)
            held += len(anchor)
            if held >= STRETCH:
                yield _by_anchor(np.concatenate(anchors_), pa.concat_arrays(places))
                anchors_, places, held = [], [], 0
        if held:
            yield _by_anchor(np.concatenate(anchors_), pa.concat_arrays(places))

    place = f"doc_id: {kind}, start: int, n: int, digest: bigint"
    return in_arrow(docs, run, f"anchor bigint, times int, {place.replace(':', '')}, "
                               f"more array<struct<{place}>>")


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``(anchor, split, doc_id, start, words)``: the words of the wanted passages; of those with
    ``split`` a hash of the words of each window instead."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    of = wanted.groupBy("doc_id").agg(
        F.collect_list(F.struct("anchor", "start", "n", "split")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_text(batches):
            rows, out = [], ([], [], [], [])
            lists = batch.column("at")
            for i, text in enumerate(texts):
                words = (text or b"").split()
                for p in lists[i].as_py():
                    start, n, split = p["start"], p["n"], p["split"]
                    if start + n + length - 1 > len(words):
                        continue  # a place of another row with this doc_id
                    for s, m in ((s, 1) for s in range(start, start + n)) if split else ((start, n),):
                        passage = b" ".join(words[s:s + m + length - 1])
                        rows.append(i)
                        for column, value in zip(out, (
                                p["anchor"], split, s, xxhash.xxh3_128_digest(passage) if split else passage)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int64()),
                 pa.array(out[1], pa.bool_()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())],
                ["doc_id", "anchor", "split", "start", "words"])

    return in_arrow(docs.join(of, "doc_id"), run,
                    f"doc_id {kind}, anchor bigint, split boolean, start int, words binary")


def _later_places(rows: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``keys`` also occur at an earlier ``(doc_id, start)``, and a row for each
    of the ``keys`` with its first place ``(_d, _s)``. Groups are partly
    aggregated; both sides of the join are tables, so Spark may split a large group."""
    first = stored(rows.groupBy(*keys).agg(
        F.min(F.struct("doc_id", "start")).alias("f"), F.count(F.lit(1)).alias("places")).select(
        *keys, F.col("f.doc_id").alias("_d"), F.col("f.start").alias("_s"), "places"), name)
    return rows.join(first.filter("places > 1").drop("places"), keys).filter(
        ~((F.col("doc_id") == F.col("_d")) & (F.col("start") == F.col("_s")))), first


def _streamed(passages: DataFrame, length: int, kind: str) -> DataFrame:
    """``(doc_id, first, last)``: spans that a shard's automaton of earlier passages matches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = automaton = None
        for batch in batches:
            keep, spans = [], []
            anchor, start, passage = (batch.column(c).to_pylist() for c in ("anchor", "start", "words"))
            for i in range(batch.num_rows):
                words = passage[i].split(b" ")
                if key != anchor[i]:
                    key, automaton = anchor[i], SuffixAutomaton()
                else:
                    here: list[tuple[int, int]] = []
                    for at, m in enumerate(automaton.statistics(words), 1):
                        if m >= length:
                            if here and here[-1][1] >= at - length:
                                here[-1] = (here[-1][0], at)
                            else:
                                here.append((at - length, at))
                    keep += [i] * len(here)
                    spans += [(start[i] + a, start[i] + b) for a, b in here]
                automaton.add(words)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(keep, pa.int64())),
                 pa.array([s[0] for s in spans], pa.int32()), pa.array([s[1] for s in spans], pa.int32())],
                ["doc_id", "first", "last"])

    shards = passages.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "start")
    return in_arrow(shards, run, f"doc_id {kind}, first int, last int")


def repeated_spans(docs: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """``(doc_id, first, last)``: spans of words (``last`` is beyond) of one passage that lie in
    windows whose words also start earlier. Intermediate tables are written on the way."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    times = F.sum("times").over(Window.partitionBy("anchor"))
    often = _passages(docs, length).withColumn("all", times).filter(F.col("all") > 1)
    place = F.struct("doc_id", "start", "n", "digest")
    wanted = stored(often.select("anchor", F.explode(F.concat(F.array(place), "more")).alias("p"))
                    .select("anchor", "p.*"), "passages")
    # equal passages: what lies at all places but the first starts earlier there
    keys = ["anchor", "digest", "n"]
    copies, first = _later_places(wanted, keys, "firsts")
    different = stored(first.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(
        "anchor", (F.col("k") > shard).alias("split")), "anchors")
    passages = stored(_contexts(docs, first.select(*keys, F.col("_d").alias("doc_id"), F.col("_s").alias(
        "start")).join(different, "anchor"), length), "contexts")
    windows, _ = _later_places(passages.filter("split"), ["anchor", "words"], "windows")
    end = F.col("start") + length - 1
    return copies.select("doc_id", F.col("start").alias("first"), (F.col("n") + end).alias("last")).unionByName(
        windows.select("doc_id", F.col("start").alias("first"), (end + 1).alias("last"))).unionByName(
        _streamed(passages.filter("NOT split"), length, kind))


def remove_repeats(docs: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` for each row of ``docs``; kept: the words left,
    joined by one space.

    A word goes if it lies in a window whose words also start earlier: in a document with a
    smaller doc_id, or earlier in the same one. Windows are judged on the input. Words are
    what lies between blanks, tabs and line ends, unchanged. Null, empty and short texts
    have no window. Rows with a null doc_id are neither earlier nor later than any other
    and stay whole. Rows that repeat a doc_id are one document: places that go in one of
    them go in all. An empty table gives an empty result. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", "text")
    spans = repeated_spans(read.filter("doc_id IS NOT NULL"), length, shard)
    of = spans.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_text(batches):
            total, gone, kept = [], [], []
            lists = batch.column("spans")
            for i, text in enumerate(texts):
                words = (text or b"").split()
                drop = np.zeros(len(words), bool)
                for s in lists[i].as_py() or ():
                    drop[s["first"]:s["last"]] = True
                total.append(len(words))
                gone.append(int(drop.sum()))
                if gone[-1]:
                    words = [w for w, d in zip(words, drop.tolist()) if not d]
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"])

    return in_arrow(read.join(of, "doc_id", "left").select("doc_id", "text", "spans"), run,
                    f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")
