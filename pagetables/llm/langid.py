"""Language identification by nearest centroid.

A text becomes a vector of hashed letter n-grams (one, two and three characters, words
bounded by a blank), weighted by TF-IDF and normalised. Each language has several
centroids, found by spherical k-means; a text gets the language of the centroid with the
largest cosine and is rejected where that cosine is far below those of the learned texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetables.llm.common import by_text, in_arrow

DIM = 4096
#: Bytes of text counted at once: about fifty times as much memory.
TEXT_BYTES = 1 << 18
#: Texts counted at once, however short: each has a row of ``DIM`` counts.
TEXTS = 256
UNKNOWN = "und"
#: Bound of the sample that centroids are fitted on, over all languages together.
SAMPLE = 4000
CENTROIDS = 4
#: A text is rejected where its cosine is below this share of the least one of the sample
#: among texts of about its number of letters.
REJECT = 0.5

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        table = np.zeros(0x110000, bool)
        for c in range(0x110000):
            table[c] = chr(c).isalpha()
        _LETTERS.append(table)
    return _LETTERS[0]


def counts(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts (a row of ``DIM`` for each text) and the number of letters."""
    lowered = [(t or b"").decode("utf-8").lower() for t in texts]
    sizes = np.array([len(t) for t in lowered], np.int64)
    # a zero before each text and two at the end, so that every letter has neighbours
    chars = np.frombuffer("\0".join(["", *lowered, "", ""]).encode("utf-32-le"), np.uint32)
    x = np.where(_letters()[chars], chars, 0).astype(np.uint32)
    ends = np.cumsum(sizes + 1)
    a, b, c = (x[:-2] * np.uint32(0x9E3779B1), x[1:-1] * np.uint32(0x85EBCA77),
               x[2:] * np.uint32(0xC2B2AE3D))
    here = x[1:-1] != 0  # the n-grams around the letter at i + 1
    shift = np.uint32(32 - int(math.log2(DIM)))
    mix = np.uint32(0x27D4EB2F)
    grams = [((b * mix) >> shift), (((a ^ (b + np.uint32(1))) * mix) >> shift),
             (((a ^ (b + c)) * mix) >> shift)]
    out = np.zeros((len(texts), DIM), np.float32)
    n = np.zeros(len(texts), np.int64)
    for i, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist())):
        lo, hi = end - size - 1, end - 1
        if not size:
            continue
        keep = np.flatnonzero(here[lo:hi])
        n[i] = len(keep)
        for g in grams:
            out[i] += np.bincount(g[lo:hi][keep], minlength=DIM)
    return out, n


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(tf) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts, and of texts with each n-gram, over all of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM, np.int64), 0
        for _, texts in by_text(batches, limit=TEXT_BYTES, most=TEXTS):
            tf, letters = counts(texts)
            df += (tf > 0).sum(axis=0)
            n += int((letters > 0).sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(np.arange(DIM), -1)), pa.array(np.append(df, n))], ["gram", "n"])

    rows = (in_arrow(docs.select("text"), run, "gram bigint, n bigint")
            .groupBy("gram").agg(F.sum("n").alias("n")).collect())  # DIM + 1 rows
    found = np.zeros(DIM + 1, np.int64)
    for r in rows:
        found[r["gram"]] = r["n"]
    return int(found[DIM]), found[:DIM]


def _kmeans(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts with the vector that is farthest from those chosen so far."""
    centres = [v.mean(axis=0)]
    best = v @ (centres[0] / max(np.linalg.norm(centres[0]), 1e-9))
    picked = [int(np.argmax(best))]
    best = v @ v[picked[0]]
    while len(picked) < min(k, len(v)):
        picked.append(int(np.argmin(best)))
        best = np.maximum(best, v @ v[picked[-1]])
    c = v[picked]
    for _ in range(rounds):
        near = np.argmax(v @ c.T, axis=1)
        c = np.stack([v[near == j].sum(axis=0) if (near == j).any() else c[j]
                      for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c.astype(np.float32)


def _bins(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(np.int64), 23)


class LanguageModel:
    """Languages, centroids (one language each), IDF and least cosines by size of text."""

    def __init__(self, langs: list[str], centroids: np.ndarray, of: np.ndarray,
                 idf: np.ndarray, least: np.ndarray):
        self.langs, self.centroids, self.of = langs, centroids, of
        self.idf, self.least = idf, least

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, cosines and whether each text is rejected. Ties go to the language
        that is first by name."""
        tf, letters = counts(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosines = vectors(tf, self.idf) @ self.centroids.T
        near = np.argmax(cosines, axis=1)
        score = np.clip(cosines[np.arange(len(texts)), near].astype(np.float64), 0, 1)
        none = letters == 0
        names = [UNKNOWN if z else self.langs[self.of[j]] for z, j in zip(none, near)]
        score[none] = 0
        return names, score, none | (score < self.least[_bins(letters)])


def train(docs: DataFrame, lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE,
          centroids: int = CENTROIDS, reject: float = REJECT) -> LanguageModel:
    """Fit a model on the rows of ``docs`` with a non-null ``lang``.

    IDF comes from all these rows. Centroids are fitted on at most about ``sample`` rows:
    as many for each language, those with the smallest hashes of ``key``.
    """
    known = docs.filter(F.col(lang).isNotNull() & F.col("text").isNotNull()).select(
        F.col(lang).alias("lang"), "text", F.xxhash64(key).alias("h"))
    n, df = document_frequencies(known)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    least = np.zeros(24)
    rows_of = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n")).collect()}  # the languages
    if not rows_of:
        return LanguageModel([], np.zeros((0, DIM), np.float32), np.zeros(0, int), idf, least)
    each = max(1, sample // len(rows_of))
    # hashes are even: a range of them that holds about as many rows as asked for
    share = F.lit(False)
    for name, n_rows in sorted(rows_of.items()):
        top = min(2**63 - 1, int(min(1.0, each / n_rows) * 2**64) - 2**63)
        share = share | ((F.col("lang") == name) & (F.col("h") <= F.lit(top)))

    def run(batches):
        for batch, texts in by_text(batches, limit=TEXT_BYTES, most=TEXTS):
            tf, letters = counts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("h"), pa.array(letters),
                 pa.array([row.astype(np.float16).tobytes() for row in np.sqrt(tf)],
                          pa.binary())], ["lang", "h", "letters", "v"])

    rows = in_arrow(
        known.filter(share), run, "lang string, h bigint, letters bigint, v binary").collect()  # about ``sample``
    rows = sorted((r for r in rows if r["letters"] > 0),
                  key=lambda r: (r["lang"], r["h"], r["v"]))
    names = sorted({r["lang"] for r in rows})
    if not rows:
        return LanguageModel([], np.zeros((0, DIM), np.float32), np.zeros(0, int), idf, least)
    tf = np.stack([np.frombuffer(r["v"], np.float16) for r in rows]).astype(np.float32) ** 2
    v = vectors(tf, idf)
    label = np.array([names.index(r["lang"]) for r in rows])
    parts = [_kmeans(v[label == i], centroids) for i in range(len(names))]
    c = np.concatenate(parts)
    of = np.repeat(np.arange(len(names)), [len(p) for p in parts])
    own = (v @ c.T).max(axis=1)
    bins = _bins(np.array([r["letters"] for r in rows]))
    floor = own.min()
    for b in range(24):
        near = own[np.abs(bins - b) <= 1]
        least[b] = reject * (near.min() if len(near) else floor)
    return LanguageModel(names, c, of, idf, least)


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)
             ) -> DataFrame:
    """Columns ``keep`` of each row with ``lang_pred``, ``score`` and ``rejected``.

    A null text, or one without a letter, is ``und`` with score 0 and rejected. A rejected
    text with letters keeps the nearest language. Without any learned language all texts
    are ``und``. Only the text is looked at, the whole of it.
    """
    keep = tuple(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_text(batches, limit=TEXT_BYTES, most=TEXTS):
            names, score, rejected = model.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(names, pa.string()),
                 pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                [*keep, "lang_pred", "score", "rejected"])

    kinds = [f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep]
    extra = [] if "text" in keep else ["text"]
    return in_arrow(
        docs.select(*keep, *extra), run, ", ".join([*kinds, "lang_pred string", "score double", "rejected boolean"]))


def held_out(key: Column) -> Column:
    """Rows that take no part in learning: crc32 of the key as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_of(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out and predict every row: ``doc_id``,
    ``held_out``, ``lang_pred``, ``score``, ``rejected``."""
    flagged = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = train(flagged.filter(~F.col("held_out")))
    return identify(flagged, model, ("doc_id", "held_out"))


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is not rejected, all columns unchanged."""
    model = train(docs.filter(~held_out(F.col("doc_id"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_text(batches, limit=TEXT_BYTES, most=TEXTS):
            _, _, rejected = model.predict(texts)
            yield batch.filter(pa.array(~rejected))

    return in_arrow(docs, run, docs.schema)
