"""Toxicity by a chain of classifiers.

Categories are predicted one after the other by logistic regression on the words of a text
and on the log-odds of the categories before it. For training these come from models that
have not seen the text (out of fold), so that a later model learns how far an earlier one
can be trusted. The same out-of-fold odds say from which probability on a text is called
toxic.

The chain is fitted on a bounded sample of the labels, chosen before any text is read: only
the texts of these are looked up, and no text is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.llm.common import by_text, in_arrow, stored
from pagetables.llm.linear import Sparse, fit, sigmoid

#: Bound of the sample of labelled rows that the chain is fitted on.
SAMPLE = 20_000
#: Bound of the words, for each category, that the chain knows.
WORDS = 4_000
FOLDS = 5
#: A word must be in so many texts of the sample.
LEAST_TEXTS = 5
#: A word must be so many standard deviations from what chance gives, for one of the categories.
SIGNIFICANT = 5.0
#: Words whose hashes or columns a task remembers.
REMEMBERED = 200_000

#: Bytes of the stems.
STEMS = (4, 5, 6)

_BLANK = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> set[bytes]:
    """Distinct words: letters, digits and anything beyond ASCII, A-Z lower-cased."""
    return set((text or b"").lower().translate(_BLANK).split())


class _Hashes(dict):
    """Hashes of a word and of the stems that it begins with, if it is longer, so that
    inflected forms count together; as bytes."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        parts = [word, *(word[:n] + b"-" for n in STEMS if len(word) > n)]
        self[word] = h = np.array([zlib.crc32(p) for p in parts], np.uint32).tobytes()
        return h


class _Columns(dict):
    """Columns of a word and its stems in a vocabulary; as bytes."""

    def __init__(self, vocabulary: dict[int, int]):
        self.vocabulary, self.hashes = vocabulary, _Hashes()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        hashes = np.frombuffer(self.hashes.__missing__(word), np.uint32).tolist()
        self.hashes.clear()
        self[word] = c = np.array([self.vocabulary[h] for h in hashes if h in self.vocabulary],
                                  np.uint32).tobytes()
        return c


def _gathered(found: dict, text: bytes | None) -> np.ndarray:
    """What a text's words have in ``found``; a stem once for each distinct word with it."""
    return np.frombuffer(b"".join(map(found.__getitem__, words(text))), np.uint32)


def _features(rows: list[np.ndarray], columns: int, dense: np.ndarray | None = None) -> Sparse:
    """The distinct columns of each row, with the roots of how often each is there."""
    width = max(columns, 1)
    row = np.repeat(np.arange(len(rows)) * width, [len(r) for r in rows])
    for at, r in zip(np.cumsum([len(r) for r in rows]), rows):
        row[at - len(r):at] += r
    flat, n = np.unique(row, return_counts=True)
    return Sparse(flat // width, flat % width, np.sqrt(n), len(rows), columns, dense)


class Chain:
    """Categories in order, word numbers, and for each category weights and intercept, and
    the probability from which it is called present."""

    def __init__(self, categories: list[str], vocabulary: dict[int, int],
                 models: list[tuple[np.ndarray, float]], least: list[float] | None = None):
        self.categories, self.vocabulary, self.models = categories, vocabulary, models
        self.least = least or [0.5] * len(categories)

    def predict(self, texts: list[bytes | None], columns: _Columns | None = None) -> np.ndarray:
        """A probability for each text and category, in the order of the chain."""
        columns = _Columns(self.vocabulary) if columns is None else columns
        n = len(self.vocabulary)
        x = _features([_gathered(columns, t) for t in texts], n)
        odds = np.zeros((len(texts), len(self.categories)))
        for j, (w, b) in enumerate(self.models):
            odds[:, j] = x.dot(w[:n]) + odds[:, :j] @ w[n:] + b
        return sigmoid(odds)


def _sampled(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int) -> DataFrame:
    """``(h, <categories>, words)``: hashes of the words of at most ``sample`` labelled rows.

    Labels are chosen by a hash of the row, then meet the documents; where doc_ids repeat and
    rows are still too many, those with the smallest hashes of their content stay.
    """
    known = labels.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("key"), F.xxhash64("doc_id").alias("h"),
        *(F.col(f"`{c}`").cast("double") for c in categories))
    n = known.count()
    top = min(2**63 - 1, int(min(1.0, sample / max(n, 1)) * 2**64) - 2**63)
    picked = stored(known.filter(F.xxhash64(*known.columns) <= F.lit(top)), "labels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch, texts in by_text(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), *(batch.column(c) for c in categories),
                 pa.array([np.sort(_gathered(hashes, t)).tobytes() for t in texts], pa.binary())],
                ["h", *categories, "words"])

    both = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(
        picked, F.col("doc_id") == F.col("key")).select("h", *categories, "text")
    schema = "h bigint, " + ", ".join(f"`{c}` double" for c in categories) + ", words binary"
    rows = in_arrow(both, run, schema)
    return stored(rows.orderBy(F.xxhash64(*rows.columns), "h", "words").limit(sample), "sample")


def _vocabulary(sample: DataFrame, categories: list[str], most: int) -> dict[int, int]:
    """Numbers of the words that tell most about a category, ``most`` for each."""
    names = [f"{kind}{j}" for j in range(len(categories)) for kind in ("n", "y")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raws in by_text(batches, "words"):
            rows = [np.unique(np.frombuffer(r, np.uint32)) for r in raws]
            hashes, of = np.unique(np.concatenate(rows), return_inverse=True)
            row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            out = [np.bincount(of, minlength=len(hashes))]
            for c in categories:
                y = np.array(batch.column(c).to_pylist(), float)  # a null is nan
                for v in (~np.isnan(y), np.nan_to_num(y)):
                    out.append(np.bincount(of, v[row], minlength=len(hashes)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.astype(np.int64)), *(pa.array(o.astype(float)) for o in out)],
                ["word", "n", *names])

    share = sample.agg(*(F.avg(c) for c in categories)).first()
    counted = in_arrow(sample, run, "word bigint, n double, " + ", ".join(f"{x} double" for x in names))
    counted = stored(counted.groupBy("word").agg(*(F.sum(x).alias(x) for x in ["n", *names])).filter(
        F.col("n") >= LEAST_TEXTS), "words")
    good = set()
    for j, p in enumerate(share):
        if p is None:
            continue
        spread = F.sqrt(F.greatest(F.col(f"n{j}") * (p * (1 - p)), F.lit(1e-9)))
        strength = F.abs(F.col(f"y{j}") - F.col(f"n{j}") * p) / spread
        good |= {r["word"] for r in counted.select("word", strength.alias("s")).filter(
            F.col("s") >= SIGNIFICANT).orderBy(F.desc("s"), "word").limit(most).collect()}
    return {h: i for i, h in enumerate(sorted(good))}


def threshold(odds: np.ndarray, y: np.ndarray) -> float:
    """Probability from which on calling a text positive has the best F1, between the two
    odds around it; 0.5 if there is nothing to choose."""
    if not (0 < y.sum() < len(y)):
        return 0.5
    order = np.argsort(-odds, kind="stable")
    z, hits = odds[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][z[:-1] == z[1:]] = 0  # equal odds are called alike
    best = int(np.argmax(f1))
    after = z[best + 1] if best + 1 < len(z) else z[best]
    return float(sigmoid((z[best] + after) / 2))


def train(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE,
          folds: int = FOLDS, l2: float = 1e-4, most: int = WORDS) -> Chain:
    """Fit a chain on the documents that ``labels`` has a row for: ``doc_id`` and a column of 0
    or 1 for each category (null: not labelled). At most ``sample`` rows and ``most`` words for
    each category are used; both are chosen on Spark."""
    rows = _sampled(docs, labels, categories, sample)
    vocabulary = _vocabulary(rows, categories, most)
    size, chosen = len(vocabulary), np.array(sorted(vocabulary), np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raws in by_text(batches, "words"):
            out = []
            for raw in raws:
                r = np.frombuffer(raw, np.uint32)
                at = np.searchsorted(chosen, r)
                out.append(at[(at < size) & (chosen[np.minimum(at, size - 1)] == r)].astype(
                    np.uint32).tobytes() if size else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), *(batch.column(c) for c in categories), pa.array(out, pa.binary())],
                ["h", *categories, "words"])

    known = stored(in_arrow(rows, run, rows.schema), "columns")
    odds, models, least = None, [], []
    for j in range(len(categories)):
        found = {r["part"]: r for r in _fits(known, size, categories, j, odds, folds, l2).collect()}
        if not found:  # no row at all
            models.append((np.zeros(size + j), 0.0))
            least.append(0.5)
            continue
        last = found[folds]
        models.append((np.frombuffer(last["weights"]), last["intercept"]))
        y = np.frombuffer(last["labels"])
        own = np.zeros((len(y), 1))
        for r in found.values():
            own[np.frombuffer(r["rows"], np.int64), 0] = np.frombuffer(r["odds"])
        given = ~np.isnan(y)
        least.append(threshold(own[given, 0], y[given]))
        odds = own if odds is None else np.append(odds, own, axis=1)
    return Chain(list(categories), vocabulary, models, least)


def _fits(known: DataFrame, size: int, categories: list[str], j: int, odds: np.ndarray | None,
          folds: int, l2: float) -> DataFrame:
    """Models of category ``j`` without each fold in turn (``part``) and on all rows (the last
    part), every one fitted by a task of its own on the bounded sample: weights, intercept, and the
    odds of the rows left out. Rows are numbered in the order of their content, which is the
    same in all tasks; ``odds`` are those of the categories before, by these numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple]] = {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "h", "words", *categories)]
            for part, *row in zip(*columns):
                parts.setdefault(part, []).append(row)
        for part in sorted(parts):
            got = sorted(parts.pop(part), key=lambda r: (r[0], r[1], repr(r[2:])))
            labels = np.array([np.nan if r[2 + j] is None else r[2 + j] for r in got], float)
            given, y = ~np.isnan(labels), np.nan_to_num(labels)
            fold = np.array([r[0] % folds for r in got], np.int64)
            x = _features([np.frombuffer(r[1], np.uint32) for r in got], size, odds)
            w, b = fit(x, y, (given & (fold != part)).astype(float), l2)
            out = np.flatnonzero(fold == part)
            whole = part == folds
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([w.tobytes()], pa.binary()), pa.array([b], pa.float64()),
                 pa.array([out.astype(np.int64).tobytes()], pa.binary()),
                 pa.array([(x.dot(w) + b)[out].tobytes()], pa.binary()),
                 pa.array([labels.tobytes() if whole else b""], pa.binary())],
                ["part", "weights", "intercept", "rows", "odds", "labels"])

    copies = known.select(F.explode(F.sequence(F.lit(0), F.lit(folds))).alias("part"), *known.columns)
    return in_arrow(copies.repartitionByRange(folds + 1, "part"), run, "part int, weights binary, "
                    "intercept double, rows binary, odds binary, labels binary")


def predict(docs: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id``, ``p_<category>`` and ``<category>_pred`` for each row, from the whole text.

    A null, empty or wordless text gets what the chain gives to no words. Rows are judged
    each by itself, repeated ones and those with a null doc_id too. A chain without
    training rows gives 0.5 and calls it present. An empty table gives no rows. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [f"p_{c}" for c in chain.categories]
    calls = [f"{c}_pred" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = _Columns(chain.vocabulary)
        for batch, texts in by_text(batches):
            p = chain.predict(texts, columns)
            called = p >= np.array(chain.least)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c) for c in (*p.T, *called.T))],
                ["doc_id", *names, *calls])

    return in_arrow(docs.select("doc_id", "text"), run, ", ".join(
        [f"doc_id {kind}", *(f"`{n}` double" for n in names), *(f"`{n}` boolean" for n in calls)]))


def toxicity(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("quality", "toxic"),
             sample: int = SAMPLE) -> DataFrame:
    """Learn from the labelled documents and predict all of them.

    ``labels`` has a row of categories for a doc_id; ``quality`` is 0 for bad texts. Labels
    of unknown documents, of null texts, and null ones, teach nothing; a document labelled
    twice is two training rows. Without any, all probabilities are 0.5. The sample is
    written before this returns.
    """
    return predict(docs, train(docs, labels, list(categories), sample))
