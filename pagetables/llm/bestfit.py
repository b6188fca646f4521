"""Packing into as few sequences as possible: dominance reduction, then best fit.

Texts of one size are alike, so what is packed is the number of texts of each size: at most
as many numbers as a sequence has tokens, at any size of the corpus. Martello and Toth's
reduction goes through the sizes from the largest down. A set of at most three texts that
fills a sequence at least as well as any other set with its largest text can be replaced by
them (it dominates them) is fixed for good, as often as its sizes allow, and leaves the instance. What is
left is packed by best fit, in falling order. The plan says which texts of a size, by rank, lie at
which place of which sequences; each text finds its rank from counts by task and size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetables.llm.common import by_text, in_arrow, stored

LENGTH = 2048
END = 0

_TOKENIZERS: dict[str, "ByteTokens"] = {}


class ByteTokens:
    """Ids of a byte-level BPE file of the library ``tokenizers``.

    Where its vocabulary in the order of ids is the order of its merges, as rank-based
    encoders ask, texts are encoded by one of these, several times as fast; a probe and all
    texts that spell a special token go through the library itself.
    """

    PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    PROBE = "Don't  stop, the 2nd 'Élan' of wörds.\r\n\n\t now... x.y, ($5.) 日本   ‍😀 End. "

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.ranked = None
        try:
            self.ranked = self._ranked()
        except (ImportError, KeyError, ValueError):
            return
        if self.ranked.encode_ordinary(self.PROBE) != self._whole(self.PROBE).tolist():
            self.ranked = None

    def _ranked(self):
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        names = {chr(b): b for b in shown}
        hidden = [b for b in range(256) if b not in shown]  # written from U+0100 on
        names |= {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(names[c] for c in token): i for token, i in self.tokenizer.get_vocab().items()
                 if token not in self.special}
        return tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        if self.ranked is None or any(s in text for s in self.special):
            return self._whole(text)
        return np.asarray(self.ranked.encode_to_numpy(text, disallowed_special=()), np.uint32)


def _tokens(path: str) -> ByteTokens:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ByteTokens(path)
    return _TOKENIZERS[path]


class Plan:
    """Places for items given as counts by size.

    ``runs`` has for each size rows ``(first rank, first sequence, offset, each)``: from the
    first rank on, ``each`` items lie side by side from the offset in each sequence.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.left = {s: n for s, n in counts.items() if n}
        self.used: dict[int, int] = defaultdict(int)
        self.runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        self._reduce()
        self.fixed = self.sequences  # by dominance
        self._best_fit()

    def _take(self, size: int, n: int, sequence: int, offset: int, each: int) -> None:
        """The next ``n`` items of a size, ``each`` to a sequence."""
        self.runs[size].append((self.used[size], sequence, offset, each))
        self.used[size] += n
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]

    # --- dominance reduction

    def _dominant(self, large: int) -> list[int] | None:
        """Sizes of a set that dominates all sets with an item of size ``large``, or None.

        Counts are those of the items beside it.
        """
        others = dict(self.left)
        others[large] -= 1
        sizes = sorted(s for s, n in others.items() if n)
        room = self.capacity - large
        smallest, k = 0, 0  # how many of the smallest fit beside it, up to 3
        for s in sizes:
            n = min(others[s], 3 - k)
            while n and smallest + s <= room:
                smallest, k, n = smallest + s, k + 1, n - 1
            if n or k == 3:
                break
        if k == 0:
            return [large]
        single = max(s for s in sizes if s <= room)
        if k == 1 or single == room:
            return [large, single]
        if k > 2:
            return None
        best, pair = 0, None
        at = np.array(sizes)
        for i, a in enumerate(sizes):  # the best partner of each item that is not larger
            if at[0] + a > room:
                break
            j = min(int(np.searchsorted(at, room - a, side="right")) - 1, i)
            if j == i and others[a] < 2:
                j -= 1
            if j >= 0 and a + sizes[j] >= best:
                best, pair = a + sizes[j], (a, sizes[j])
        if single >= best:
            return [large, single]
        a, b = pair
        if a != single:
            return None
        above = []  # the two smallest items larger than b
        for s in sizes:
            if s > b:
                above += [s] * min(others[s], 2 - len(above))
            if len(above) == 2:
                break
        # any other pair has one item of at most b, or does not fit
        return [large, a, b] if len(above) < 2 or sum(above) > room else None

    def _reduce(self) -> None:
        for large in sorted(self.left, reverse=True):
            while self.left.get(large):
                chosen = self._dominant(large)
                if chosen is None:
                    break
                # the reason holds on while all sizes of the set last
                n = min(self.left[s] // chosen.count(s) for s in set(chosen))
                offset = 0
                for s in dict.fromkeys(chosen):
                    each = chosen.count(s)
                    self._take(s, n * each, self.sequences, offset, each)
                    offset += s * each
                self.sequences += n

    # --- best fit of what is left

    def _fill(self, size: int, room: int, first: int, n: int, open_: dict) -> int:
        """Put items of a size into up to ``n`` sequences with this room; how many got some."""
        each = room // size
        full, rest = divmod(self.left[size], each)
        if full >= n:
            full, rest = n, 0
        for sequences, items in ((full, each), (bool(rest), rest)):
            if sequences:
                self._take(size, sequences * items, first, self.capacity - room, items)
                open_[room - items * size].append((first, sequences))
                first += sequences
        return full + bool(rest)

    def _best_fit(self) -> None:
        open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room: first, how many
        for size in sorted(self.left, reverse=True):
            for room in sorted(r for r in open_ if r >= size):  # the least room first
                for first, n in open_.pop(room):
                    done = self._fill(size, room, first, n, open_) if size in self.left else 0
                    if done < n:
                        open_[room].append((first + done, n - done))
                if size not in self.left:
                    break
            if size in self.left:
                self.sequences += self._fill(size, self.capacity, self.sequences,
                                             self.left[size], open_)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """All runs by size and rank, and where each size begins among them."""
        sizes = range(self.capacity + 1)
        begins = np.cumsum([0] + [len(self.runs.get(s, ())) for s in sizes])
        rows = [r for s in sizes for r in self.runs.get(s, ())]
        return np.array(rows, np.int64).reshape(-1, 4), begins


def tokenised(docs: DataFrame, path: str, length: int, end: int) -> DataFrame:
    """``(doc_id, ids, n, size, rank, wholes, task)``: ids of the text and ``end``, their
    number, what is left of it beside whole sequences, and how many texts with this size, and
    how many whole sequences, the task had before."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(path)
        seen, wholes = np.zeros(length, np.int64), 0
        for batch, texts in by_text(batches):
            out = [[] for _ in range(5)]
            for text in texts:
                ids = np.append(tokens.encode((text or b"").decode("utf-8")), np.uint32(end))
                size = len(ids) % length
                for column, value in zip(out, (ids.astype(tokens.width).tobytes(), len(ids), size,
                                               int(seen[size]), wholes)):
                    column.append(value)
                seen[size] += 1
                wholes += len(ids) // length
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out[0], pa.binary()),
                 *(pa.array(c, pa.int64()) for c in out[1:])],
                ["doc_id", "ids", "n", "size", "rank", "wholes"])

    return in_arrow(docs.select("doc_id", "text"), run,
                    f"doc_id {kind}, ids binary, n bigint, size bigint, rank bigint, wholes bigint"
                    ).withColumn("task", F.spark_partition_id())


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces of texts in as few sequences of at most ``length`` tokens as can be.

    One row for each piece: ``doc_id, piece, start, length, ids, sequence_id, offset``; ids
    as little-endian unsigned 32-bit integers. A text's ids are those of the tokenizer and
    ``end``. Only longer ones are cut: the first piece is what is left beside whole
    sequences, the others fill one each, with negative sequence ids. Pieces of a sequence
    follow each other without gaps from offset 0. Null and empty texts are ``end`` alone.
    Repeated rows and rows with a null doc_id are packed each by itself. An empty table
    gives no pieces. Other columns are not read. Tokens are written before this returns;
    the driver sees the number of texts of each size, at most ``length`` rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    kept = stored(tokenised(docs, path, length, end), "tokens")
    width = np.uint16 if kept.isEmpty() else _tokens(path).width
    by_task = kept.filter("size > 0").groupBy("task", "size").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("size").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = stored(by_task.select("task", "size", "k", F.coalesce(
        F.sum("k").over(before), F.lit(0).cast("bigint")).alias("before")), "ranks")
    counts = {r["size"]: r["n"] for r in first.groupBy("size").agg(F.sum("k").alias("n")).collect()}
    runs, begins = Plan(counts, length).table()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raws in by_text(batches, "ids"):
            rows, out = [], [[] for _ in range(6)]
            task, size, rank, wholes = (batch.column(c).to_pylist()
                                        for c in ("task", "size", "rank", "wholes"))
            for i, raw in enumerate(raws):
                ids = np.frombuffer(raw, width).astype("<u4")
                places = []
                if size[i]:
                    a, b = begins[size[i]], begins[size[i] + 1]
                    r = a + np.searchsorted(runs[a:b, 0], rank[i], side="right") - 1
                    by, at = divmod(rank[i] - int(runs[r, 0]), int(runs[r, 3]))
                    places.append((0, size[i], int(runs[r, 1]) + by, int(runs[r, 2]) + at * size[i]))
                for k, start in enumerate(range(size[i], len(ids), length)):
                    places.append((start, length, -1 - (task[i] << 33) - wholes[i] - k, 0))
                for piece, (start, n, sequence, offset) in enumerate(places):
                    rows.append(i)
                    for column, value in zip(out, (piece, start, n, ids[start:start + n].tobytes(),
                                                   sequence, offset)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int32()),
                 pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary()),
                 pa.array(out[4], pa.int64()), pa.array(out[5], pa.int64())],
                ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    # the counts grow with the tasks and are larger than stored, so they are not broadcast
    offsets = first.select("task", "size", "before").hint("merge")
    placed = kept.join(offsets, ["task", "size"], "left").select(
        "doc_id", "ids", "task", "size", "wholes",
        (F.col("rank") + F.coalesce("before", F.lit(0))).alias("rank"))
    return in_arrow(placed, cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary, "
                                 "sequence_id bigint, offset bigint")
