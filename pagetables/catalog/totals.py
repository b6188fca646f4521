"""Totals at every level, rows that are not known yet, records embedded as JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetables.catalog.base import EXTRACTED_AT, LISTED, query, work_dir
from pagetables.operators import embedded, known, rollup
from pagetables.operators.records import typed_record
from pagetables.plans.extract import extract_sales
from pagetables.sources import render
from pagetables.sources.tables import materialise


def sold(spark, sf_dir):
    """Typed records with the month of their sale and their run."""
    records = typed_record(extract_sales(render.result_pages(spark, sf_dir), EXTRACTED_AT))
    return materialise(records.select(
        "municipality", F.date_format("sale_date_value", "MM").alias("month"), "source", "owner_name",
        F.col("sale_price_num").cast("decimal(18,2)").alias("price")), "sold", work_dir(spark))


SOLD = LISTED + """, sale AS (SELECT municipality, strftime(sold_at, '%m') AS month, source, owner_name,
  CAST(substr(sale_price, 2) AS DECIMAL(18,2)) AS price FROM shown)
SELECT grouping_id(municipality, month, source) AS level, municipality, month, source, count(*) AS n_rows,
       CAST(sum(price) AS DECIMAL(38,2)) AS total, count(DISTINCT owner_name) AS n_distinct FROM sale GROUP BY """


def _query(spark, sf_dir, levels):
    found = rollup.level_totals(sold(spark, sf_dir), ["municipality", "month", "source"], "price", "owner_name", levels)
    return found.withColumn("total", F.col("total").cast("decimal(38,2)"))


@query("totals_cube_distinct", SOLD + "CUBE (municipality, month, source)")
def cube(spark, sf_dir):
    return _query(spark, sf_dir, "cube")


@query("totals_rollup_distinct", SOLD + "ROLLUP (municipality, month, source)")
def rolled_up(spark, sf_dir):
    return _query(spark, sf_dir, "rollup")


@query("totals_grouping_sets", SOLD + "GROUPING SETS ((municipality, source), (month), ())")
def grouping_sets(spark, sf_dir):
    return _query(spark, sf_dir, [["municipality", "source"], ["month"], []])


@query("new_pages_known", """
SELECT page_id, url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages k WHERE k.page_id % 3 <> 0 AND k.url = p.url
  AND (CASE WHEN k.page_id % 5 = 0 THEN k.html || ' ' ELSE k.html END) = p.html)""")
def new_pages(spark, sf_dir):
    """Pages that were not stored before with this address and content."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    content = lambda html: F.sha2(html, 256).alias("content")
    html = F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit(" "))).otherwise(F.col("html"))
    stored = pages.filter("page_id % 3 <> 0").select("url", content(html))
    arrived = pages.select("page_id", "url", content(F.col("html")))
    return known.anti_join_known(arrived, stored, ["url", "content"], work_dir=work_dir(spark)).drop("content")


@query("customers_without_orders", """
SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 4 = 1)""")
def without_orders(spark, sf_dir):
    """A filter far too small: nearly all rows go on to the exact join."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderkey % 4 = 1")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    return known.anti_join_known(customers, orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"],
                                 bits=64, work_dir=work_dir(spark))


def json_pages(spark, sf_dir):
    """Pages of up to ten orders: an array, or an object for the first order alone; each seventh page is cut off,
    some prices are texts, and one of three records has a rating."""
    k = F.col("o_orderkey")
    price = F.when(k % 6 == 1, F.concat(F.lit('"'), F.col("o_totalprice").cast("decimal(18,2)"), F.lit('"'))).otherwise(
        F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    record = F.concat(F.lit('{"id": '), k, F.lit(', "price": '), price, F.lit(', "by": {"name": "O\'Neil \\"'), F.col("o_custkey"),
                      F.lit('\\""}'), F.when(k % 3 == 0, F.concat(F.lit(', "rating": '), k % 5)).otherwise(F.lit("")), F.lit("}"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.floor(k / 10).alias("page_id"), k.alias("k"), record.alias("r"))
    texts = orders.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("k", "r"))).alias("rs")).withColumn(
        "rs", F.transform("rs", lambda x: x["r"]))
    listed = F.concat(F.lit("[\n"), F.array_join("rs", ",\n"), F.lit("]"))
    text = F.when(F.col("page_id") % 7 == 3, F.substring(listed, 1, 40)).when(
        F.col("page_id") % 7 == 5, F.element_at("rs", 1)).otherwise(listed)
    return texts.select("page_id", F.lit("http://json.example.com/").alias("url"), F.concat(
        F.lit('<html><head><script>var a = {"id": 1};</script><SCRIPT async type="application/ld+json">'), text,
        F.lit('</SCRIPT><script type=application/json>{"page": '), F.col("page_id"), F.lit("}</script></head></html>")).alias("html"))


HELD = """
WITH held AS (SELECT o_orderkey AS k, o_orderkey // 10 AS page_id, o_custkey, o_totalprice,
  row_number() OVER (PARTITION BY o_orderkey // 10 ORDER BY o_orderkey) AS r FROM orders),
shown AS (SELECT * FROM held WHERE page_id % 7 <> 3 AND (page_id % 7 <> 5 OR r = 1))
"""


@query("json_records", HELD + """
SELECT page_id, CAST(r AS INTEGER) AS record_idx, k AS id, CASE WHEN k % 6 = 1 THEN 'text' ELSE 'number' END AS price_kind,
       CAST(o_totalprice AS DECIMAL(18,2)) AS price, 'O''Neil "' || CAST(o_custkey AS VARCHAR) || '"' AS by_name,
       CASE WHEN k % 3 = 0 THEN k % 5 END AS rating FROM shown""")
def json_records(spark, sf_dir):
    """Fields as columns, by the schema found in all records; a price is a text or a number."""
    records = embedded.embedded_records(json_pages(spark, sf_dir)).filter("block_idx = 1")
    found = embedded.embedded_columns(records)
    price = F.col("price")
    return found.select(
        "page_id", "record_idx", "id", F.when(F.schema_of_variant(price) == "STRING", "text").otherwise("number").alias("price_kind"),
        F.try_variant_get(price, "$", "decimal(18,2)").alias("price"), F.col("by.name").alias("by_name"), "rating")


@query("json_bad_blocks", HELD + """
SELECT page_id, CAST(count(*) FILTER (page_id % 7 <> 3 AND (page_id % 7 <> 5 OR r = 1)) + 1 AS BIGINT) AS n_records,
       CAST(max(CASE WHEN page_id % 7 = 3 THEN 1 ELSE 0 END) AS BIGINT) AS n_bad FROM held GROUP BY page_id""")
def bad_blocks(spark, sf_dir):
    records = embedded.embedded_records(json_pages(spark, sf_dir))
    return records.groupBy("page_id").agg(F.count_if(~F.col("is_bad")).alias("n_records"), F.count_if("is_bad").alias("n_bad"))
