"""Reading stored pages and writing records."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetables.functions.fixed import FRIENDLY_HEADINGS, SALES_FIELDS, WIDE_FIELDS

PAGES_SCHEMA = "page_id bigint, url string, html string"


def scratch_path(spark: SparkSession, name: str, work_dir: str | None = None) -> str:
    """A new path in ``work_dir``, by default the folder that ``spark.checkpoint.dir`` names.

    The folder must be one that the driver and all executors share, so there is no other
    default: without either this raises ``ValueError``.
    """
    root = work_dir or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("intermediate tables need a shared folder: give work_dir or set "
                         "spark.checkpoint.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, work_dir: str | None = None) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage, keeps columns
    prunable, and survives the loss of executors. The table stays until the caller empties
    the folder, since what is read from it is evaluated later."""
    spark = df.sparkSession
    path = scratch_path(spark, name, work_dir)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def work_partitions(spark: SparkSession) -> int:
    """Number of partitions for pages about to be parsed: a few for each core, as pages cost work
    and not bytes, and as many as the session shuffles to at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def read_pages(spark: SparkSession, path: str, format: str = "parquet",
               partitions: int | None = None) -> DataFrame:
    """``pages(page_id, url, html)`` from Parquet or JSON, or from a folder of HTML files
    ('binaryFile'; the path becomes the url). ``partitions`` spreads few large files."""
    if format == "binaryFile":
        files = spark.read.format("binaryFile").load(path)
        pages = files.select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"),
                             F.decode("content", "UTF-8").alias("html"))
    elif format == "json":
        pages = spark.read.schema(PAGES_SCHEMA).json(path)
    else:
        pages = spark.read.format(format).load(path)
    return pages.repartition(partitions) if partitions else pages


def run_path(folder: str, name: str, at: datetime) -> str:
    """``folder/name_YYYYMMDD_HHMMSS``."""
    return f"{folder.rstrip('/')}/{name}_{at:%Y%m%d_%H%M%S}"


def _texts(records: DataFrame, fields: list[str]) -> list:
    return [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields]


def _write_csv(df: DataFrame, path: str, header: bool = True, line_end: str = "\n") -> None:
    (df.write.option("header", header).option("escape", '"').option("quote", '"')
     .option("emptyValue", "").option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).option("encoding", "UTF-8")
     .option("lineSep", line_end).csv(path))


def _in_page_order(records: DataFrame, ordered: bool, work_dir: str | None) -> DataFrame:
    """A range sort reads its input twice, once to sample it; the records are stored first
    so that they are extracted once."""
    order = [c for c in ("page_id", "table_idx", "row_idx") if c in records.columns]
    if not (ordered and order):
        return records
    return materialise(records, "unordered", work_dir).orderBy(*order)


def write_sales_csv(records: DataFrame, path: str, ordered: bool = False,
                    line_end: str = "\n", work_dir: str | None = None) -> str:
    """UTF-8 CSV in field order, one part file per task, each with the header. ``ordered``
    range-sorts the records, so that the parts follow the pages."""
    _write_csv(_in_page_order(records, ordered, work_dir).select(
        *_texts(records, SALES_FIELDS)), path, line_end=line_end)
    return path


def write_wide_csv(records: DataFrame, path: str, ordered: bool = False,
                   line_end: str = "\n", work_dir: str | None = None) -> str:
    """CSV in the fixed column order with readable headings; each part starts with the
    byte-order mark that spreadsheets look for."""
    named = _in_page_order(records, ordered, work_dir).select(*_texts(records, WIDE_FIELDS)).toDF(
        *[("\ufeff" if i == 0 else "") + FRIENDLY_HEADINGS[f]
          for i, f in enumerate(WIDE_FIELDS)])
    _write_csv(named, path, line_end=line_end)
    return path


def write_json(records: DataFrame, path: str, fields: list[str] = WIDE_FIELDS) -> str:
    """JSON Lines with every field, '' where missing; other scripts are kept as they are."""
    records.select(*[F.col(f) if f == "page_number" else F.coalesce(F.col(f), F.lit("")).alias(f)
                     for f in fields]).write.json(path)
    return path


def write_run(records: DataFrame, folder: str, at: datetime) -> str:
    """Append a run to a folder partitioned by ``run_ts``, for readers that prune by run."""
    records.withColumn("run_ts", F.lit(f"{at:%Y%m%d_%H%M%S}")).write.mode("append") \
        .partitionBy("run_ts").parquet(folder)
    return folder


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Read a CSV written by this module; '' stays ''. Files of records whose texts hold no
    line ends can be split between tasks: ``multi_line=False``."""
    df = (spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
          .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
          .csv(path))
    names = [c.lstrip("\ufeff") for c in df.columns]
    return df.toDF(*names).fillna("")
