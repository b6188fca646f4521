"""Helpers shared by the operators: stored intermediate tables, Arrow batches, components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task works on at once.
TEXT_BYTES = 1 << 20


def work_dir(spark: SparkSession) -> str:
    """Shared folder of the session. Where none is named, one of its own is set in local mode, as in
    tests; on a cluster this raises ``ValueError``, since machines do not share their folders."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("intermediate tables need a shared folder: set spark.checkpoint.dir")
        shared = tempfile.mkdtemp(prefix="llm-work-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Cuts the lineage: lost executors cost no more than the stage that runs. The table's
    size is known from then on, so that Spark broadcasts it only where it is small.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_text(batches: Iterable[pa.RecordBatch], column: str = "text",
            limit: int = TEXT_BYTES, most: int | None = None
            ) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Cut batches so that the texts of each take about ``limit`` bytes, and are ``most`` texts at
    most, if given; a longer text is alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        texts = batch.column(column).cast(pa.binary())
        sizes = np.asarray(pa.compute.binary_length(texts).fill_null(0))
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            if most is not None:
                to = min(to, at + most)
            yield batch.slice(at, to - at), texts.slice(at, to - at).to_pylist()
            at = to


def _ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    path = f"{tempfile.mkdtemp(prefix='llm-code-')}/{package.name}_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


_SHIPPED: set[str] = set()


def in_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
             schema) -> DataFrame:
    """``mapInArrow`` with this package on the executors."""
    _ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. ``lower`` does the same where a text holds ASCII only."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges ``(a, b)``: ``(node, root)``, root the smallest node.

    Stars by turns: each larger neighbour of a node is tied to the node's smallest
    neighbour, then each smaller one. Minima are partly aggregated before the shuffle and
    the joins on a node are plain equi-joins, so a node with very many neighbours can be
    split. Every round is stored; the number of rounds grows with the logarithm of the
    longest path.
    """
    a, b = F.col("a"), F.col("b")
    now = stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
                 .filter(a != b).distinct(), "edges")
    state = None
    while True:
        both = now.select("a", "b").union(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m"))
        large = both.filter(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b"))
        large = large.filter(a != b).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = (small.filter(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).distinct())
        now = stored(small, "edges")
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            return now.select(a.alias("node"), b.alias("root"))
        state = tuple(found)
