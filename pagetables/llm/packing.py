"""Packing along a space-filling curve.

A text's token ids become a vector of few dimensions by a fixed random projection; the
vector's place on a Hilbert curve orders the texts, so that neighbours in a sequence are
alike. The ids are laid end to end along the curve and cut at every multiple of the
sequence length: no sequence but the last is padded.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.llm.common import by_text, in_arrow, stored

LENGTH = 2048
END = 1
DIMS, BITS = 4, 10
#: Words whose ids a Python worker remembers: those met again, and the latest ones.
OFTEN, LATEST = 300_000, 200_000
#: New words that are encoded as one line.
LINE = 64

#: Signs at the end of a word: found by themselves first, which is cheap, then by the letter before.
_SIGN = r"[!-/:-@\[-`{-~]"
_ENDING = re.compile(rf"({_SIGN})(?<=[a-z\u00df-\u00f6\u00f8-\u00ff]{_SIGN})({_SIGN}*+)(?=[ \n]|\Z)")
_BEYOND = re.compile(r"[^\x00-\u024f]")
_PROBE = "Don't  STOP, the 2nd 'Élan' of wörds.\nnow... x.y, ($5.) what?! a%%% it's' <b> End."


class ChunkTokens:
    """Token ids of whole texts, word by word.

    For a tokenizer that lower-cases, drops white space, never joins letters with other
    characters and marks the end of a word, the ids of a text are those of its words end to
    end. Texts are cut at blanks and line feeds, and ASCII signs that follow a letter at the end of a word are
    cut off; words met before are looked up, others go through the tokenizer together. If
    the tokenizer does not do this with a probe, texts are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.often: dict[str, bytes] = {}
        self.latest: dict[str, bytes] = {}
        self.by_word = True
        self.by_word = self.encode([_PROBE])[0].tolist() == self._whole([_PROBE])[0].tolist()

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in
                self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _cut(text: str) -> list[str]:
        if "<|" not in text and (text.isascii() or not _BEYOND.search(text)):
            text = _ENDING.sub(r" \1\2", text.lower())
        return text.replace("\n", " ").split(" ")

    def _encode_new(self, new: list[str]) -> dict[str, bytes]:
        found = {}
        plain = [w for w in new if w.isalpha()]
        for at in range(0, len(plain), LINE):
            part = plain[at:at + LINE]
            line = " ".join(part)
            if not line.isascii() and _BEYOND.search(line):
                continue
            ids = np.array(self.tokenizer.encode(line, add_special_tokens=False).ids, np.uint32)
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()  # a word is one run of letters
            if len(cuts) == len(part):
                raw = ids.tobytes()
                found |= zip(part, map(raw.__getitem__, map(slice, [0, *cuts], cuts)))
        rest = [w for w in new if w not in found]
        for at in range(0, len(rest), 4096):
            part = rest[at:at + 4096]
            found |= zip(part, (array("I", e.ids).tobytes() for e in
                                self.tokenizer.encode_batch_fast(part, add_special_tokens=False)))
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return self._whole(texts)
        words = [self._cut(t) for t in texts]
        found, new = {}, []
        for w in set().union(*words):
            ids = self.often.get(w)
            if ids is None and (ids := self.latest.pop(w, None)) is not None:
                if len(self.often) >= OFTEN:
                    self.often.clear()
                self.often[w] = ids
            if ids is None:
                new.append(w)
            else:
                found[w] = ids
        fresh = self._encode_new(new)
        found |= fresh
        if len(self.latest) + len(fresh) > LATEST:
            self.latest.clear()
        if len(fresh) <= LATEST:
            self.latest |= fresh
        return [np.frombuffer(b"".join(map(found.__getitem__, ws)), np.uint32) for ws in words]


_TOKENS: dict[str, ChunkTokens] = {}


def tokens_of(path: str) -> ChunkTokens:
    if path not in _TOKENS:
        _TOKENS[path] = ChunkTokens(path)
    return _TOKENS[path]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (a row each) with ``bits`` a dimension."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of each level, from the top
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> bit & 1)
    return key


def _projection(vocabulary: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((vocabulary, DIMS)).astype(np.float32)


_MATRIX: dict[int, np.ndarray] = {}


def places(ids: list[np.ndarray], vocabulary: int = 1 << 16) -> np.ndarray:
    """Hilbert places of the texts: the sum of their tokens' random directions, by the root
    of their number and squashed."""
    if vocabulary not in _MATRIX:
        _MATRIX[vocabulary] = _projection(vocabulary)
    flat = np.concatenate(ids) % vocabulary
    sizes = np.array([len(i) for i in ids])
    v = np.add.reduceat(_MATRIX[vocabulary][flat], np.cumsum(sizes) - sizes, axis=0)
    v /= 2 * np.sqrt(sizes)[:, None]
    cells = ((v / (1 + np.abs(v)) + 1) / 2 * (1 << BITS)).astype(np.int64)
    return hilbert(np.clip(cells, 0, (1 << BITS) - 1), BITS)


def _width(path: str) -> type:
    """Kind of a stored id; found on the driver, as reading the file takes a while."""
    from tokenizers import Tokenizer

    return np.uint16 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else np.uint32


def tokenised(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """``(row_id, doc_id, place, n, ids)``: ids of the whole text and ``end``, little-endian."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    width = _width(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_text(batches):
            ids = tokens_of(path).encode([(t or b"").decode("utf-8") for t in texts])
            ids = [np.append(i, np.uint32(end)) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(places(ids)),
                 pa.array([len(i) for i in ids], pa.int64()),
                 pa.array([i.astype(width).tobytes() for i in ids], pa.binary())],
                ["doc_id", "place", "n", "ids"])

    return (in_arrow(docs.select("doc_id", "text"), run,
                     f"doc_id {kind}, place bigint, n bigint, ids binary")
            .withColumn("row_id", F.monotonically_increasing_id()))


def _running(order: DataFrame) -> DataFrame:
    """``(row_id, at)``: tokens before each text along the curve.

    Texts are range-sorted by place; each task adds up its own, and the tasks' totals, one
    row for each, are added up on the driver.
    """
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            n = np.asarray(batch.column("n"))
            ends = total + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), batch.column("n"), pa.array(ends - n)],
                ["row_id", "n", "at"])
            total = int(ends[-1]) if len(ends) else total

    spark = order.sparkSession
    ranged = (order.repartitionByRange("place", "row_id")
              .sortWithinPartitions("place", "row_id"))
    sorted_ = stored(in_arrow(ranged, local, "row_id bigint, n bigint, at bigint")
                     .withColumn("part", F.spark_partition_id()), "order")
    totals = sorted(tuple(r) for r in sorted_.groupBy("part").agg(F.sum("n")).collect())
    before, sums = 0, []
    for part, n in totals:
        sums.append((part, before))
        before += n
    offsets = spark.createDataFrame(sums, "part int, before bigint")
    return sorted_.join(offsets, "part").select("row_id", (F.col("at") + F.col("before")).alias("at"))


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces of texts in sequences of ``length`` tokens.

    One row for each piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``;
    ids as little-endian unsigned 32-bit integers. Every id of every text, and ``end``
    after it, lies in exactly one piece; the pieces of a sequence follow each other without
    gaps from offset 0. Null and empty texts are ``end`` alone. Repeated rows and rows with
    a null doc_id are packed like any other, each by itself. Texts longer than a sequence
    are cut. An empty table gives no pieces. Other columns are not read.
    """
    kept = stored(tokenised(docs, path, end), "tokens")
    at = _running(kept.select("row_id", "place", "n"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    width = _width(path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids in by_text(batches, "ids"):
            rows, out = [], {k: [] for k in ("start", "length", "ids", "doc_tokens",
                                             "sequence_id", "offset")}
            for i, (raw, begin) in enumerate(zip(ids, batch.column("at").to_pylist())):
                tokens = np.frombuffer(raw, width).astype("<u4")
                start = 0
                while start < len(tokens):
                    sequence, offset = divmod(begin + start, length)
                    n = min(length - offset, len(tokens) - start)
                    rows.append(i)
                    for k, v in (("start", start), ("length", n), ("doc_tokens", len(tokens)),
                                 ("ids", tokens[start:start + n].tobytes()),
                                 ("sequence_id", sequence), ("offset", offset)):
                        out[k].append(v)
                    start += n
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())),
                 *(pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items())],
                ["doc_id", *out])

    placed = kept.select("row_id", "doc_id", "ids").join(at, "row_id")
    return in_arrow(placed.select("doc_id", "ids", "at"),
                    cut, f"doc_id {kind}, start bigint, length bigint, ids binary, "
                         "doc_tokens bigint, sequence_id bigint, offset bigint")

