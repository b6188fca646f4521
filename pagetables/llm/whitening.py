"""Whitening of embeddings from exact cross-products, by bit-sliced scatter.

Entries become integers. Within a block of rows each dimension is shifted by its least value
and cut into bit planes; a plane holds one bit of 64 rows in a word. The product of two
planes, summed over the rows, is the number of bits set in their AND, so the weighted
popcounts of all pairs of planes are the exact scatter of the block, however large the
entries are. A dimension that is always 1 goes along and gives sums and counts. Blocks are
added up as integers on Spark, the covariance is centred as an integer matrix, and only
then becomes double precision for ``eigh``.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.llm.common import in_arrow, stored

#: Rows whose planes are in memory at once; a multiple of 64.
ROWS = 8192
#: Bits of a limb that sums travel in; a long holds the sum of 2**31 of them.
LIMB = 32
#: A component whose variance is not above this share of the largest one has none.
FLAT = 1e-13


def planes(x: np.ndarray) -> np.ndarray:
    """Bit planes of non-negative integers, a row for each value: ``(bits, columns, words)``."""
    bits = max(1, int(x.max(initial=0)).bit_length())
    words = -(-len(x) // 64)
    out = np.zeros((bits, x.shape[1], words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits((x >> np.uint64(b) & np.uint64(1)).astype(np.uint8), axis=0)
        out[b, :, :len(packed)] = packed.T
    return out.view(np.uint64)


def scatter(x: np.ndarray) -> np.ndarray:
    """Exact ``x.T @ x`` of non-negative integers, by popcounts of ANDed bit planes."""
    sliced = planes(x)
    bits, d, _ = sliced.shape
    kind = np.int64 if 2 * bits + len(x).bit_length() < 63 else object
    weights = np.array([1 << b for b in range(bits)], kind)
    total = np.zeros((d, d), object)
    for i in range(d):
        row = np.zeros(d - i, kind)
        for a in range(bits):
            common = np.bitwise_count(sliced[:, i:] & sliced[a, i]).sum(axis=2, dtype=np.int64)
            row += weights[a] * (weights @ common.astype(kind))
        total[i, i:] = total[i:, i] = row
    return total


def block_scatter(x: np.ndarray) -> np.ndarray:
    """Exact ``z.T @ z`` as Python integers, where z is ``x`` with a last column of ones."""
    z = np.concatenate((x, np.ones((len(x), 1), np.int64)), axis=1)
    least = z.min(axis=0)
    least[-1] = 0
    shifted = z.astype(np.uint64) - least.astype(np.uint64)  # modulo 2**64, so never overflows
    g, m = scatter(shifted), least.astype(object)
    sums, n = g[:, -1].copy(), int(g[-1, -1])
    return g + np.outer(m, sums) + np.outer(sums, m) + n * np.outer(m, m)


def _matrix(batch: pa.RecordBatch, column: str, d: int) -> np.ndarray:
    flat = batch.column(column).flatten()
    return np.asarray(flat, dtype=np.int64).reshape(-1, d)


def integer_vectors(vectors: DataFrame, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """``(vec_id, x)``: ``x = floor(scale * c) + offset`` of the usable vectors' entries.

    Null and empty vectors, and those with a null or non-finite entry or one beyond the
    range of a long, are left out. Where lengths differ, those of the most frequent length
    stay (of the greatest, if two are as frequent).
    """
    e = F.col("embedding")
    usable = F.coalesce(F.forall(e, lambda c: c.isNotNull() & (
        F.abs(c.cast("double")) * scale < 2.0 ** 62)), F.lit(False))  # nan is above all numbers
    rows = vectors.select("vec_id", "embedding").filter(e.isNotNull() & (F.size(e) > 0) & usable)
    usual = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(
        F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("embedding") == (usual["d"] if usual else 0)).select(
        "vec_id", F.transform(e, lambda c: F.floor(c.cast("double") * scale) + F.lit(offset)).alias("x"))


def total_scatter(distinct: DataFrame, d: int) -> np.ndarray:
    """Exact scatter of column ``x`` with a dimension of ones, ``(d + 1, d + 1)`` integers.

    Each task adds up its blocks and gives one row for each entry and limb; the driver gets
    the sums, whose number depends on the dimensions alone.
    """
    entries = np.triu_indices(d + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kept, held = np.zeros((d + 1, d + 1), object), [], 0
        for batch in batches:
            x = _matrix(batch, "x", d)
            while len(x):
                kept.append(x[:ROWS - held])
                x, held = x[ROWS - held:], held + len(kept[-1])
                if held == ROWS:
                    total += block_scatter(np.concatenate(kept))
                    kept, held = [], 0
        if held:
            total += block_scatter(np.concatenate(kept))
        rows, limb = [], 0
        rest = [(k, int(v)) for k, v in enumerate(total[entries]) if v]
        while rest:  # the last limb takes the sign
            rows += [(k, limb, v if abs(v) < 1 << LIMB else v & ((1 << LIMB) - 1)) for k, v in rest]
            rest = [(k, v >> LIMB) for k, v in rest if abs(v) >= 1 << LIMB]
            limb += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 3,
            ["entry", "limb", "value"])

    sums = in_arrow(distinct.select("x"), run, "entry bigint, limb bigint, value bigint").groupBy(
        "entry", "limb").agg(F.sum("value").alias("value"))
    out = np.zeros((d + 1, d + 1), object)
    for entry, limb, value in sums.collect():
        i, j = int(entries[0][entry]), int(entries[1][entry])
        out[i, j] += value << (LIMB * limb)
        if i != j:
            out[j, i] = out[i, j]
    return out


class Whitening:
    """Count, sums and covariance of the fit list, and its principal components."""

    def __init__(self, scattered: np.ndarray, components: int):
        self.n = n = int(scattered[-1, -1])
        self.sums = [int(s) for s in scattered[:-1, -1]]
        d = len(self.sums)
        # n * scatter - S S', as integers; n * n times the covariance
        centred = n * scattered[:-1, :-1] - np.outer(self.sums, np.array(self.sums, object))
        self.covariance = np.array([[float(Fraction(int(v), n * n)) for v in row] for row in centred],
                                   float).reshape(d, d)
        values, vectors = np.linalg.eigh(self.covariance)
        values, vectors = values[::-1], vectors[:, ::-1]
        some = values > FLAT * max(values[0], 0)
        keep = np.flatnonzero(some)[:components]
        self.values, self.vectors = values[keep], vectors[:, keep]
        self.explained = self.values / np.trace(self.covariance) if len(keep) else np.zeros(0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S`` exactly: int64 where that fits, else Python integers."""
        s = np.array(self.sums, object)
        top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
        if self.n * top + max(map(abs, self.sums)) < 1 << 62:
            return self.n * x - s.astype(np.int64)
        return self.n * x.astype(object) - s

    def project(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ self.vectors / np.sqrt(self.values)


def fit(distinct: DataFrame, components: int = 16) -> Whitening | None:
    """Fit on the rows of ``x``; None without rows."""
    one = distinct.select(F.size("x")).first()
    return Whitening(total_scatter(distinct, one[0]), components) if one else None


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened fit list minus the identity, measured
    on its rows."""
    d, k = len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            if batch.num_rows:
                z = model.project(model.centred(_matrix(batch, "x", d)))
                z = np.concatenate((z, np.ones((len(z), 1))), axis=1)
                total += z.T @ z
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(total.size)), pa.array(total.ravel())], ["entry", "value"])

    sums = in_arrow(distinct.select("x"), run, "entry bigint, value double").groupBy("entry").agg(
        F.sum("value").alias("value")).collect()
    total = np.zeros((k + 1) ** 2)
    for entry, value in sums:
        total[entry] = value
    total = total.reshape(k + 1, k + 1) / model.n
    spread = total[:k, :k] - np.outer(total[:k, k], total[:k, k])
    return float(np.abs(spread - np.eye(k)).max(initial=0))


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, offset: int = 1_000_000
           ) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for each
    usable row and component.

    Components are numbered from 1 by falling variance, up to ``components`` or as many as
    have any variance: without variance (one distinct vector, none) there are no rows.
    ``deviation`` is the exact sum over the dimensions of ``(n * x - S) ** 2``, a
    decimal. Null, empty, non-finite vectors and those of another than the usual length are
    left out, see ``integer_vectors``; repeated rows, rows with one vec_id and rows with a
    null vec_id are rows each. Other columns are not read. The fit list and the integer
    vectors are written before this returns.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, "
              "explained double, identity_error double")
    rows = stored(integer_vectors(vectors, scale, offset), "integers")
    distinct = stored(rows.select("x").distinct(), "fit")
    model = fit(distinct, components)
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    error, d, k = identity_error(distinct, model), len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                m = batch.num_rows
                c = model.centred(_matrix(batch, "x", d))
                if c.dtype != object and int(np.abs(c).max()) ** 2 * d < 1 << 62:
                    deviation = pa.array((c * c).sum(axis=1)).cast(pa.decimal128(38, 0))
                else:
                    deviation = pa.array([sum(int(v) ** 2 for v in row) for row in c],
                                         pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(each),
                     pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, model.n)), deviation.take(each),
                     pa.array(model.project(c).ravel()), pa.array(np.tile(model.explained, m)),
                     pa.array(np.full(m * k, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained",
                     "identity_error"])

    return in_arrow(rows, run, schema)
