"""Page sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetables.catalog.base import EXTRACTED_AT, LISTED, query, work_dir
from pagetables.catalog.scan import pages as stored_pages
from pagetables.operators import sequence as Q
from pagetables.plans import extract, listing
from pagetables.sources import render
from pagetables.sources.tables import materialise


def bare_pages(spark, sf_dir):
    """Rendered pages without the columns that say where they stand."""
    return render.result_pages(spark, sf_dir).select("page_id", "url", "html", "source")


@query("seq1_total_pages", LISTED + """
SELECT source, CAST(60 AS INTEGER) AS total_pages, count(*) AS n_pages FROM paged GROUP BY source""")
def total_pages(spark, sf_dir):
    return Q.total_pages(bare_pages(spark, sf_dir)).groupBy("source").agg(
        F.max("total_pages").alias("total_pages"), F.count("total_pages").alias("n_pages"))


@query("seq2_current_page", LISTED + "SELECT page_id, page_no FROM paged")
def current_page(spark, sf_dir):
    unnamed = bare_pages(spark, sf_dir).withColumn("url", F.lit("http://listing.example.com/"))
    return Q.current_page(unnamed).select("page_id", "page_no")


@query("seq2_current_page_long", """
SELECT page_id, CAST(1000 + 7 * page_id AS INTEGER) AS page_no FROM pages""")
def current_page_long(spark, sf_dir):
    """Numbers in the address have no upper end."""
    number = (1000 + 7 * F.col("page_id")).cast("string")
    pages = stored_pages(spark, sf_dir).withColumn(
        "url", F.concat(F.lit("http://listing.example.com/all?page="), number))
    return Q.current_page(pages).select("page_id", "page_no")


def odd_pagers(spark, sf_dir):
    """Pages without a pager but with fractions in cells; pages whose next link lies inside
    a marked element; pages with script links, all alike."""
    k = F.col("o_orderkey")
    cell = F.concat(F.lit("<table><tr><td>1/2 interest</td><td>2 of "), k.cast("string"),
                    F.lit("</td></tr></table>"))
    inner = F.concat(F.lit('<ul><li class="next"><a href="/list/'), (k + 1).cast("string"),
                     F.lit('">more</a></li></ul>'))
    script = F.lit("<a href=\"javascript:__doPostBack('n')\">Next</a>")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(
        k.alias("page_id"), F.concat(F.lit("http://a.example.com/list/"), k.cast("string")).alias("url"),
        F.concat(F.lit("<html><body>"), cell, F.when(k % 3 == 0, inner).when(k % 3 == 1, script)
                 .otherwise(F.concat(F.lit("<p>Page 3 of "), (k + 5).cast("string"), F.lit("</p>"))),
                 F.lit("</body></html>")).alias("html"))


@query("seq1_total_pages_odd", """
SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 3 = 2 THEN CAST(o_orderkey + 5 AS INTEGER) END
  AS total_pages FROM orders""")
def total_pages_odd(spark, sf_dir):
    return Q.total_pages(odd_pagers(spark, sf_dir)).select("page_id", "total_pages")


@query("seq3_follow_next_odd", """
SELECT o.o_orderkey AS page_id, n.o_orderkey AS next_page_id FROM orders o
LEFT JOIN orders n ON o.o_orderkey % 3 = 0 AND n.o_orderkey = o.o_orderkey + 1""")
def follow_next_odd(spark, sf_dir):
    return Q.follow_next(odd_pagers(spark, sf_dir)).select("page_id", "next_page_id")


@query("seq2_current_page_stored", """
SELECT page_id, host, CAST(coalesce(CAST(nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '')
         AS INTEGER), row_number() OVER (PARTITION BY host ORDER BY page_id)) AS INTEGER) AS page_no
FROM (SELECT *, regexp_extract(url, '://([^/]*)', 1) AS host FROM pages)""")
def current_page_stored(spark, sf_dir):
    pages = stored_pages(spark, sf_dir).withColumn(
        "host", F.regexp_extract("url", "://([^/]*)", 1))
    return Q.current_page(pages, source="host").select("page_id", "host", "page_no")


@query("seq3_next_link", LISTED + """
SELECT page_id, CAST(CASE WHEN run_no % 3 = 1 AND page_no = 59 THEN 6 WHEN NOT has_next THEN NULL
         WHEN run_no % 3 = 0 THEN 1 WHEN run_no % 3 = 1 THEN 6 ELSE 4 END AS INTEGER) AS next_rank,
       CASE WHEN has_next THEN stem || CAST(page_no + 1 AS VARCHAR) END AS next_url FROM paged""")
def next_link(spark, sf_dir):
    return Q.next_link(bare_pages(spark, sf_dir)).select("page_id", "next_rank", "next_url")


@query("seq3_follow_next", LISTED + """
SELECT p.page_id, n.page_id AS next_page_id FROM paged p
LEFT JOIN paged n ON p.run_no = n.run_no AND n.page_no = p.page_no + 1 AND p.has_next""")
def follow_next(spark, sf_dir):
    return Q.follow_next(bare_pages(spark, sf_dir)).select("page_id", "next_page_id")


def facts(spark, sf_dir):
    return materialise(listing.page_facts(render.result_pages(spark, sf_dir)), "facts", work_dir(spark))


@query("seq4_page_limit", LISTED + """
SELECT source, page_no FROM paged WHERE page_no <= least(50, 60)""")
def page_limit(spark, sf_dir):
    return Q.page_limit(render.result_pages(spark, sf_dir).drop("html"), max_pages=50).select("source", "page_no")


@query("seq5_stop_after_empty_run", LISTED + """
, f AS (SELECT source, page_no, sum(is_empty::INTEGER) OVER (PARTITION BY source ORDER BY page_no
    ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS third FROM paged)
SELECT source, page_no FROM f QUALIFY NOT coalesce(max(third) OVER (PARTITION BY source
  ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)""")
def stop_after_empty_run(spark, sf_dir):
    return Q.stop_after_empty_run(facts(spark, sf_dir), run=3).select("source", "page_no")


@query("seq6_page_totals", LISTED + """
, c AS (SELECT source, page_no AS page_number, count(*) AS n_records FROM shown GROUP BY ALL)
SELECT *, CAST(sum(n_records) OVER (PARTITION BY source ORDER BY page_number) AS BIGINT)
  AS running_total FROM c""")
def page_totals(spark, sf_dir):
    records = extract.extract_sales(render.result_pages(spark, sf_dir), EXTRACTED_AT)
    return Q.page_totals(records, work_dir=work_dir(spark)).select("source", "page_number", "n_records", "running_total")


@query("seq7_stop_without_next", LISTED + """
SELECT source, page_no FROM paged QUALIFY coalesce(min(has_next::INTEGER) OVER (
  PARTITION BY source ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) = 1""")
def stop_without_next(spark, sf_dir):
    return Q.stop_without_next(facts(spark, sf_dir)).select("source", "page_no")


VISITED = """
(run_no % 3 = 0 AND page_no <= 50 OR run_no % 3 = 1 AND page_no <= 22
 OR run_no % 3 = 2 AND page_no <= 40)"""


@query("seq_page_set", LISTED + f"SELECT source, page_no FROM paged WHERE {VISITED}")
def page_set(spark, sf_dir):
    return Q.page_set(facts(spark, sf_dir), max_pages=50, run=3).select("source", "page_no")


@query("fl6_page_number_range", """
SELECT o_orderkey, CASE WHEN o_orderkey BETWEEN 1 AND 1000 THEN CAST(o_orderkey AS INTEGER) END
  AS page_no FROM orders""")
def page_number_range(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", Q.page_number_range(
        F.col("o_orderkey").cast("string")).alias("page_no"))


BOUNDED = {"max_pages": 50, "empty_run": 3, "without_next": True}


@query("run_listing_all", LISTED + """
SELECT source, page_no, row_idx, sale_price, owner_name, property_address, parcel_number
FROM shown""")
def run_listing_all(spark, sf_dir):
    """No rule is asked for: every record of every page, numbered by what the pages show."""
    pages = render.result_pages(spark, sf_dir).drop("page_no")
    return listing.run_listing(pages, EXTRACTED_AT, work_dir=work_dir(spark)).select(
        "source", "page_no", "row_idx", "sale_price", "owner_name", "property_address",
        "parcel_number")


@query("run_listing", LISTED + f"""
SELECT source, page_no, row_idx, sale_price, owner_name, property_address, parcel_number
FROM shown WHERE {VISITED}""")
def run_listing(spark, sf_dir):
    return listing.run_listing(
        render.result_pages(spark, sf_dir), EXTRACTED_AT, work_dir=work_dir(spark), **BOUNDED).select(
        "source", "page_no", "row_idx", "sale_price", "owner_name", "property_address",
        "parcel_number")


@query("search_listing", LISTED + f"""
SELECT page_id, row_idx, owner_name, property_address, municipality,
  CAST(substr(sale_price, 2) AS DECIMAL(18,2)) AS sale_price_num,
  CAST(square_footage AS INTEGER) AS square_footage_int
FROM shown WHERE {VISITED} AND municipality = 'CITY BC'
  AND CAST(square_footage AS INTEGER) >= 5000""")
def search_listing(spark, sf_dir):
    return listing.search_listing(
        render.result_pages(spark, sf_dir), EXTRACTED_AT, municipality="CITY BC", min_sqft=5000,
        work_dir=work_dir(spark), **BOUNDED).select("page_id", "row_idx", "owner_name", "property_address",
                              "municipality", "sale_price_num", "square_footage_int")
