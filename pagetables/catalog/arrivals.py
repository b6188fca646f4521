"""Stop rules and keyed saving over pages that arrive in any order."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetables.catalog.base import EXTRACTED_AT, LISTED, query, work_dir
from pagetables.catalog.sequence import VISITED
from pagetables.operators import sequence as Q
from pagetables.plans import extract
from pagetables.sources import render, tables
from pagetables.streaming import keyed, rules, stream


@query("src2_stop_rules_stream", LISTED + f"SELECT source, page_no FROM paged WHERE {VISITED}")
def stop_rules_stream(spark, sf_dir):
    """Pages arrive mixed, in two runs of the stream."""
    folder = tables.scratch_path(spark, "arriving", work_dir(spark))
    pages = render.result_pages(spark, sf_dir).drop("page_no").withColumn("_at", F.pmod(F.xxhash64("page_id"), F.lit(6)))
    pages = tables.materialise(pages, "mixed", work_dir(spark))
    held = rules.StopRules(spark, f"{folder}-state", max_pages=50, empty_run=3)
    schema = pages.drop("_at").schema
    for part in ("_at < 3", "_at >= 3"):
        pages.filter(part).repartition(3, "_at").drop("_at").write.mode("append").parquet(folder)
        arriving = stream.read_pages_stream(
            spark, folder, schema, files_per_batch=2, partitions=tables.work_partitions(spark))
        rules.follow_arrivals(arriving, held, f"{folder}-log").awaitTermination()
    stored = spark.read.schema(schema).parquet(folder).repartition(tables.work_partitions(spark))
    numbered = Q.current_page(stored).select("source", "page_no")
    return held.visited(numbered)


CRAWLED_TWICE = LISTED + """
, crawl AS (SELECT page_id, row_idx, property_address, 1 AS capture, sale_price FROM shown
            UNION ALL SELECT page_id, row_idx, property_address, 2, sale_price || '9' FROM shown WHERE page_id % 3 = 0)
SELECT page_id, row_idx, arg_max(property_address, capture) AS property_address,
       CAST(max(capture) AS INTEGER) AS capture, arg_max(sale_price, capture) AS sale_price
FROM crawl GROUP BY page_id, row_idx"""


@query("snk6_keyed_save", CRAWLED_TWICE)
def keyed_save(spark, sf_dir):
    """A third of the pages is crawled again; the newer capture may arrive first."""
    folder = tables.scratch_path(spark, "crawls", work_dir(spark))
    records = tables.materialise(extract.extract_sales(render.result_pages(spark, sf_dir), EXTRACTED_AT).select(
        "page_id", "row_idx", "property_address", "sale_price"), "sales", work_dir(spark))
    first = records.withColumn("capture", F.lit(1))
    again = records.filter("page_id % 3 = 0").withColumn("capture", F.lit(2)).withColumn(
        "sale_price", F.concat("sale_price", F.lit("9")))
    schema = "page_id bigint, row_idx int, property_address string, sale_price string, capture int"
    table = keyed.KeyedTable(spark, f"{folder}-table", schema, ["page_id", "row_idx"], "capture", buckets=8)
    # three files each, however many the records have: a batch writes the buckets it touches anew
    for crawl in (first.unionByName(again), again.unionByName(first.filter("page_id % 3 = 1"))):
        crawl.repartition(3, "page_id").select(*table.names).write.mode("append").parquet(folder)
        arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(folder)
        keyed.save_keyed(arriving, table, f"{folder}-log").awaitTermination()
    return table.read()
