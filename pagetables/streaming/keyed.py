"""A saved table with one row for each key, the newest capture.

Rows lie in buckets of their key's hash. A batch merges its rows into the buckets that it
touches and writes these anew, under its own number; then one small list says which
number holds for each bucket from this batch on. The list is one file, so readers have all of a batch
or nothing of it. A batch done again, after a failure at any point, starts
from the list before it and writes the same, so that rows never double.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from pagetables.streaming.log import BatchLog

BUCKETS = 64


class KeyedTable:
    """The table in ``folder``: rows of ``schema``, one for each ``keys``, that with the greatest
    ``newest``. Rows of one key and capture are told apart by their whole content, the greatest stays.
    Rows with NULL in a key are a key of their own kind."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], newest: str,
                 buckets: int = BUCKETS):
        self.spark, self.keys, self.newest, self.buckets = spark, keys, newest, buckets
        self.rows = BatchLog(spark, f"{folder}/rows", f"{schema}, bucket int", ["bucket"])
        self.lists = BatchLog(spark, f"{folder}/lists", "bucket int, version bigint")
        self.names = [f.name for f in self.rows.read().schema if f.name not in ("bucket", "batch")]

    def _list(self, before: int | None = None) -> DataFrame:
        """``(bucket, version)`` of the last list, at most one row for each bucket."""
        lists = self.lists.read(before)
        last = lists.agg(F.max("batch").alias("batch"))
        return lists.join(last, "batch").select("bucket", "version")

    def _rows(self, before: int | None = None) -> DataFrame:
        held = self._list(before).collect()  # at most ``buckets`` rows; they choose the folders to read
        wanted = F.lit(False)
        for version in {r["version"] for r in held}:
            of = [r["bucket"] for r in held if r["version"] == version]
            wanted |= (F.col("batch") == version) & F.col("bucket").isin(of)
        return self.rows.read().filter(wanted)

    def read(self) -> DataFrame:
        return self._rows().select(*self.names)

    def merge(self, rows: DataFrame, batch: int) -> None:
        """Merge the rows of a batch. Doing this again for the same batch changes nothing."""
        bucket = F.pmod(F.hash(*self.keys), F.lit(self.buckets)).alias("bucket")
        new = rows.select(*self.names, bucket)
        touched = new.select("bucket").distinct()
        old = self._rows(before=batch).select(*self.names, "bucket").join(touched, "bucket", "left_semi")
        order = F.struct(self.newest, *(c for c in self.names if c != self.newest))
        merged = old.unionByName(new).groupBy("bucket", *[F.col(k).alias(f"_{k}") for k in self.keys]).agg(
            F.max(order).alias("r")).select("r.*", "bucket")
        self.rows.write(merged, batch)
        done = self.rows.read().filter(F.col("batch") == batch).select("bucket").distinct()
        now = self._list(before=batch).join(done, "bucket", "left_anti").unionByName(
            done.select("bucket", F.lit(batch).cast("bigint").alias("version")))
        if not rows.isEmpty():
            self.lists.write(now.coalesce(1), batch)


def save_keyed(records: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Merge what has arrived into the table; a restart goes on after the last finished batch."""
    return (records.writeStream.foreachBatch(table.merge).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
