"""Exact top-k search by inner product, block of dimensions by block of dimensions.

Queries and candidates are dealt into blocks of a bounded number of rows; each task gets one
block of queries and one of candidates, kept in vertical layout: one contiguous matrix for
each block of dimensions. Scores are accumulated block by block. After each block the
scores still to come are bounded by the product of the norms of what remains of either
vector; candidates whose best case is below the k-th best worst case are compacted away.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetables.llm.common import in_arrow, stored

#: Rows of a block, and dimensions accumulated at once.
CANDIDATES, QUERIES, DIMENSIONS = 8192, 1024, 16


def _rests(x: np.ndarray) -> np.ndarray:
    """Norm of what remains after each block of dimensions; a column for each block."""
    squares = x.astype(np.float64) ** 2
    ends = range(DIMENSIONS, x.shape[1] + DIMENSIONS, DIMENSIONS)
    return np.stack([np.sqrt(squares[:, e:].sum(axis=1)) for e in ends], axis=1)


def best(queries: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int):
    """The k highest inner products of each query with the rows of ``x``, ties to the smaller
    id, rows of the query's own id aside: rows ``(query, row of x, score)``."""
    exact = x.shape[1] * max(1, np.abs(queries).max(initial=0)) * max(
        1, np.abs(x).max(initial=0)) < 2 ** 53
    kind = np.float64 if exact else object  # beyond 2**53 Python's integers
    starts = range(0, x.shape[1], DIMENSIONS)
    blocks = [np.ascontiguousarray(x[:, s:s + DIMENSIONS]).astype(kind) for s in starts]
    rest, q_rest = _rests(x), _rests(queries)
    found = []
    for i, q in enumerate(queries.astype(kind)):
        alive = np.flatnonzero(ids != q_ids[i])
        part = np.zeros(len(alive), kind)
        for j, s in enumerate(starts):
            part = part + blocks[j][alive] @ q[s:s + DIMENSIONS]
            if len(alive) > k and exact:
                open_ = rest[alive, j] * q_rest[i, j] * (1 + 1e-9)
                worst = np.partition(part - open_, len(alive) - k)[len(alive) - k]
                keep = part + open_ >= worst - 1e-6 * abs(worst) - 1
                alive, part = alive[keep], part[keep]
        order = sorted(range(len(alive)), key=lambda a: (-part[a], ids[alive[a]]))[:k]
        found += [(i, int(alive[a]), int(part[a])) for a in order]
    return found


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` highest scores of each query.

    A vector's components become floor(scale * x). Queries are the rows that ``is_query``
    holds for, candidates all rows but those of the query's own vec_id; fewer than ``k``
    candidates are all returned. Ties go to the smaller vec_id. Rows with a null vec_id or
    vector, or with a null or non-finite component, take no part; vectors meet those of
    their own length; an empty vector scores 0. Repeated candidate rows are candidates each;
    repeated query rows are one query, and rows of one vec_id with other vectors are
    queries each. An empty table gives no rows. Other columns are not read.
    """
    e = F.col("embedding")
    whole = F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x) != float("inf"))), F.lit(False))
    rows = vectors.filter(F.col("vec_id").isNotNull() & e.isNotNull() & whole).select(
        "vec_id", F.transform(e, lambda x: F.floor(x.cast("double") * scale)).alias("x"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = stored(rows.withColumn("d", F.size("x")), "vectors")
    n = rows.agg(F.count(F.lit(1)), F.sum(F.col("is_query").cast("int"))).first()
    of_c = max(1, -(-n[0] // CANDIDATES))
    of_q = max(1, -(-(n[1] or 0) // QUERIES))
    zero = F.lit(0).cast("bigint")
    asked = rows.filter("is_query").select("vec_id", "x", "d").distinct()
    asked = asked.select("vec_id", "x", "d", F.lit(True).alias("asked"),
                         F.pmod(F.xxhash64("vec_id", "x"), F.lit(of_q)).alias("q"),
                         F.explode(F.sequence(zero, zero + (of_c - 1))).alias("c"))
    others = rows.select("vec_id", "x", "d", F.lit(False).alias("asked"),
                         F.explode(F.sequence(zero, zero + (of_q - 1))).alias("q"),
                         F.pmod(F.xxhash64("vec_id", "x"), F.lit(of_c)).alias("c"))

    def search(batches):
        for ids, x, is_q in _groups(batches):
            q = x[is_q]
            found = best(q, ids[is_q], x[~is_q], ids[~is_q], k) if len(q) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[is_q][[f[0] for f in found]] if found else [], pa.int64()),
                 pa.array([q[f[0]].tobytes() for f in found], pa.binary()),
                 pa.array(ids[~is_q][[f[1] for f in found]] if found else [], pa.int64()),
                 pa.array([f[2] for f in found], pa.int64())],
                ["query_id", "vector", "vec_id", "score"])

    blocks = (others.unionByName(asked).repartition("q", "c", "d")
              .sortWithinPartitions("q", "c", "d"))
    near = in_arrow(blocks, search, "query_id bigint, vector binary, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "vector").orderBy(F.desc("score"), "vec_id")
    return (near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _groups(batches):
    """Ids, integer vectors and the query flag of each block pair, in the order they come."""
    kept: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("q", "c", "d"))))
        start = 0
        for i in range(len(keys) + 1):
            if i == len(keys) or (key is not None and keys[i] != key):
                if i > start:
                    kept.append(batch.slice(start, i - start))
                start = i
                if i < len(keys):
                    if kept:
                        yield _matrix(kept)
                    kept = []
            if i < len(keys):
                key = keys[i]
    if kept:
        yield _matrix(kept)


def _matrix(batches: list[pa.RecordBatch]):
    table = pa.Table.from_batches(batches).combine_chunks()
    ids = table.column("vec_id").to_numpy()
    flat = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1) if len(flat) else np.zeros((len(ids), 1), np.int64), \
        table.column("asked").to_numpy(zero_copy_only=False)
