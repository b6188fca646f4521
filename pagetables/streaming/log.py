"""Tables that a stream keeps beside its output, as a log of batches.

A batch writes a folder of its own, named by its number, as a whole: doing a batch again
writes the same folder again, so a replay after a failure changes nothing. Readers see the folders of
finished batches only. The state lies in the shared folder, not in executors, so it survives
all of them, and a restart goes on from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BatchLog:
    """A table with a column ``batch``, the number of the batch that wrote the row."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, partition_by: list[str] | None = None):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.partition_by = partition_by or []
        # an empty folder for readers before the first batch
        spark.createDataFrame([], f"{schema}, batch bigint").write.mode("append").partitionBy(
            "batch", *self.partition_by).parquet(self.folder)

    def write(self, df: DataFrame, batch: int) -> None:
        """Replace what the batch has written."""
        names = [f.name for f in self.read().schema if f.name != "batch" and f.name not in self.partition_by]
        writer = df.select(*names, *self.partition_by).write.mode("overwrite")
        if self.partition_by:
            writer = writer.partitionBy(*self.partition_by)
        writer.parquet(f"{self.folder}/batch={batch}")

    def read(self, before: int | None = None) -> DataFrame:
        """Rows of all batches, or of those before one, which is what a batch may read."""
        df = self.spark.read.schema(f"{self.schema}, batch bigint").parquet(self.folder)
        return df if before is None else df.filter(F.col("batch") < before)
