"""Pages that arrive over time: the extraction plans are narrow, so they run on a stream
as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from pagetables.operators.records import dedupe_keys
from pagetables.sources.tables import PAGES_SCHEMA


def read_pages_stream(spark: SparkSession, folder: str, schema=PAGES_SCHEMA,
                      glob: str | None = None, files_per_batch: int | None = None,
                      partitions: int | None = None) -> DataFrame:
    """Pages from Parquet files that appear in a folder. ``partitions`` spreads the pages of a
    batch, since few small files are otherwise parsed by few tasks."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    pages = reader.parquet(folder)
    return pages.repartition(partitions) if partitions else pages


def append_records(records: DataFrame, path: str, checkpoint: str,
                   format: str = "parquet") -> StreamingQuery:
    """Process what has arrived and append the records; a restart goes on where the last
    committed batch ended, so a stopped run keeps what it has saved."""
    return (records.writeStream.format(format).outputMode("append")
            .option("checkpointLocation", checkpoint).option("path", path)
            .trigger(availableNow=True).start())


def dedupe_stream(records: DataFrame, scope: str = "all", arrival: str | None = None,
                  lateness: str = "1 day", unbounded_state: bool = False) -> DataFrame:
    """First record to arrive of each (address, parcel, owner). The state of a key is dropped
    ``lateness`` after its ``arrival`` time; without such a column the state grows with the
    keys, which has to be asked for by ``unbounded_state``."""
    if arrival is None and not unbounded_state:
        raise ValueError("give an arrival time column, or ask for unbounded_state")
    names = ["k_address", "k_parcel", "k_owner"]
    keyed = records.select("*", *dedupe_keys()).filter(
        "concat(k_address, k_parcel, k_owner) <> ''")
    keys = names + (["page_id"] if scope == "page" else [])
    if arrival is None:
        first = keyed.dropDuplicates(keys)
    else:
        first = keyed.withWatermark(arrival, lateness).dropDuplicatesWithinWatermark(keys)
    return first.drop(*names)
