"""Listing pages rendered from the order tables, to check extraction at any scale.

Each order becomes one listing row. 25 orders make a page and 60 pages make a run, by
arithmetic on the order key, so rendering needs no window over a run. What a page shows is
known from the tables, which lets plain SQL over the tables check what extraction finds.

By run (``run_no % 3``) and page:
The pager differs by run, too.
* runs 1, 4, ..: pages 20-22 are empty;  runs 2, 5, ..: page 10 is empty and page 40 has no
  next link;  the last page of each run has no next link;  page 59 still shows a spinner.
By ``page_no % 4``: 1 leaves out end tags and uses entities, 2 writes tags in capitals,
3 writes the headings as td.
On each page the row of order key % 25 = 7 appears a second time at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_PAGE, PAGES_PER_RUN = 25, 60
HEADINGS = ["Sale Price", "Sale Date", "Owner Name", "Location", "Municipality", "Sq. Ft",
            "Homestead", "Parcel Number"]
MENU = "<table class=menu><tr><td>menu</td><td>help</td></tr></table>"
CELLS = ["sale_price", "sale_date", "owner_name", "property_address", "municipality",
         "square_footage", "homesteaded", "parcel_number"]


def letters(c: Column) -> Column:
    return F.translate(c.cast("string"), "0123456789", "ABCDEFGHIJ")


def is_empty_page() -> Column:
    kind = F.col("run_no") % 3
    return (((kind == 1) & F.col("page_no").between(20, 22))
            | ((kind == 2) & (F.col("page_no") == 10)))


def has_next_page() -> Column:
    return (F.col("page_no") < PAGES_PER_RUN) & ~(
        (F.col("run_no") % 3 == 2) & (F.col("page_no") == 40))


def listing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with the texts its listing row shows."""
    def table(name):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    joined = table("orders").join(table("customer"), F.col("o_custkey") == F.col("c_custkey")) \
        .join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("o_orderkey")
    per_run = ROWS_PER_PAGE * PAGES_PER_RUN
    return joined.select(
        F.floor(key / ROWS_PER_PAGE).alias("page_id"),
        F.floor(key / per_run).alias("run_no"),
        (F.floor((key % per_run) / ROWS_PER_PAGE) + 1).cast("int").alias("page_no"),
        (key % ROWS_PER_PAGE).cast("int").alias("row_no"),
        key.alias("order_key"),
        F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
        .alias("sale_price"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("sale_date"),
        F.concat(F.lit("OWNER "), letters(F.col("c_custkey"))).alias("owner_name"),
        F.concat((key + 1).cast("string"), F.lit(" "), letters(key), F.lit(" CIR"))
        .alias("property_address"),
        F.concat(F.lit("CITY "), letters(F.col("n_nationkey"))).alias("municipality"),
        (F.lit(500) + (key * 37) % 49000).cast("string").alias("square_footage"),
        F.when(F.col("o_orderstatus") == "F", "Y").otherwise("N").alias("homesteaded"),
        F.concat_ws("-", F.lpad((key % 100).cast("string"), 2, "0"),
                    F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"),
                    F.lpad((key % 1000).cast("string"), 3, "0"),
                    F.lpad((F.floor(key / 100) % 10000).cast("string"), 4, "0"))
        .alias("parcel_number"))


def page_url(page_no: Column) -> Column:
    return F.concat(F.lit("http://listing.example.com/run-"), F.col("run_no").cast("string"),
                    F.lit("/search?page="), page_no.cast("string"))


def _by_page(rows: DataFrame, item: Column) -> DataFrame:
    """Pages with ``items`` in row order; a page holds 25 rows and a repeated one."""
    repeated = F.when(F.col("row_no") == 7, F.array(F.col("row_no"), F.lit(ROWS_PER_PAGE))) \
        .otherwise(F.array("row_no"))
    items = rows.withColumn("item", item).select(
        "page_id", "run_no", "page_no", "item", F.explode(repeated).alias("at"))
    # as many partitions as the session works with: pages cost work, not bytes, so they
    # are not merged by size; the grouping below reuses this partitioning
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
            spark.sparkContext.defaultParallelism)
    return items.repartition(n, "page_id", "run_no", "page_no").groupBy("page_id", "run_no", "page_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"])
        .alias("items"))


def _pager(page_no: Column) -> Column:
    """By run: 'Page X of Y' and Next; a numbered list; 'X/Y' and an arrow."""
    number = page_no.cast("string")
    following = (page_no + 1).cast("string")
    named = F.concat(
        F.lit('<div class="pager"><span class="current">'), number, F.lit("</span> Page "), number,
        F.lit(f" of {PAGES_PER_RUN} "),
        F.when(has_next_page(), F.concat(F.lit('<a href="search?page='), following,
                                         F.lit('">Next &gt;</a>'))).otherwise(""),
        F.lit("</div>"))
    listed = F.concat(
        F.lit('<ul class="pagination"><li><a href="search?page=1">1</a></li><li class="active"><a>'),
        number, F.lit("</a></li>"),
        F.when(has_next_page(), F.concat(
            F.lit('<li><a href="search?page='), following, F.lit('">'), following,
            F.lit("</a></li>"))).otherwise(""),
        F.lit(f'<li><a href="search?page={PAGES_PER_RUN}">{PAGES_PER_RUN}</a></li></ul>'))
    short = F.concat(
        F.lit('<div class="pager"><a class="current">'), number, F.lit("</a> at "), number,
        F.lit(f"/{PAGES_PER_RUN} "),
        F.when(has_next_page(), F.concat(F.lit('<a title="Next Page" href="search?page='),
                                         following, F.lit('">&gt;</a>'))).otherwise(""),
        F.lit("</div>"))
    kind = F.col("run_no") % 3
    return F.when(kind == 1, listed).when(kind == 2, short).otherwise(named)


def _pages(grouped: DataFrame, content: Column) -> DataFrame:
    spinner = F.when(F.col("page_no") == 59, '<div class="spinner"></div>').otherwise("")
    html = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>Search results</title>"
              "<style>td{margin:0}</style><script>var t=\"<table><tr><td>x</td></tr>\";</script>"
              "</head><body><!-- <table> -->"),
        spinner,
        F.when(is_empty_page(), "<p>No records found</p>").otherwise(content),
        _pager(F.col("page_no")), F.lit("</body></html>"))
    return grouped.select(
        "page_id", page_url(F.col("page_no")).alias("url"), html.alias("html"),
        F.concat(F.lit("run-"), F.col("run_no").cast("string")).alias("source"), "page_no",
        F.lit(PAGES_PER_RUN).alias("total_pages"))


def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a results table: ``page_id, url, html, source, page_no, total_pages``."""
    style = F.col("page_no") % 4
    end = F.when(style == 1, "").otherwise("</td>")
    owner = F.when(style == 1, F.regexp_replace("owner_name", " ", "&nbsp;")).otherwise(
        F.col("owner_name"))
    link = F.concat(F.lit('<a href="/detail/parcel?id='), F.col("order_key").cast("string"),
                    F.lit('&amp;v=1">'), F.col("property_address"), F.lit("</a>"))
    shown = {"owner_name": owner, "property_address": link}
    row = F.concat(
        F.lit("<tr>"),
        *[F.concat(F.lit("<td>"), shown.get(c, F.col(c)), end) for c in CELLS],
        F.when(style == 1, "").otherwise("</tr>"))
    cased = F.when(style == 2, F.regexp_replace(F.regexp_replace(
        row, "<(/?)td>", "<$1TD>"), "<(/?)tr>", "<$1TR>")).otherwise(row)

    def heading(tag):
        return "<tr>" + "".join(f"<{tag}>{h}</{tag}>" for h in HEADINGS) + "</tr>"

    head = F.when(style == 3, heading("td")).otherwise(heading("th"))
    grouped = _by_page(listing_rows(spark, sf_dir), cased)
    content = F.concat(F.lit(MENU + "<table>"), head, F.array_join("items", "\n"),
                       F.lit("</table>"))
    return _pages(grouped, content)


def compact_text() -> Column:
    """The listing row as one compact line."""
    k = F.col("order_key").cast("string")
    return F.concat(
        F.col("sale_price"), F.lit(" "), F.col("sale_date"), F.lit(" "), F.col("owner_name"),
        F.lit(" & "), F.col("property_address"), F.lit(" "), F.col("municipality"), F.lit(" "),
        F.col("square_footage"), F.lit(" "), F.col("property_address"), F.lit(" "),
        F.col("municipality"), F.lit(" FL "),
        F.lpad((F.col("order_key") % 100000).cast("string"), 5, "0"), F.lit(" "), k, F.lit(" "),
        F.col("homesteaded"), F.lit(" QV MAP"))


def prose_text() -> Column:
    """The listing row as a sentence for the sales rules."""
    return F.concat(
        F.lit("Sold "), F.date_format(F.col("sale_date").cast("date"), "M/d/yyyy"),
        F.lit(" for "), F.col("sale_price"), F.lit(" by "),
        F.initcap(F.concat(F.lit("ow"), F.lower(F.substring("owner_name", 7, 20)))), F.lit(", "),
        F.initcap(F.concat(F.lit("ci"), F.lower(F.substring("municipality", 6, 20)))),
        F.lit(" at "), (F.col("order_key") + 1).cast("string"), F.lit(" "),
        F.initcap(F.concat(F.lit("bo"), F.lower(letters(F.col("order_key"))))),
        F.lit(" Lane in Jupiter, area "), F.col("square_footage"), F.lit(", "),
        F.col("parcel_number"), F.lit(", homestead "),
        F.when(F.col("homesteaded") == "Y", "Yes").otherwise("No"))


def facts_text() -> Column:
    """The listing row as labelled facts for the wide rules."""
    k = F.col("order_key")
    return F.concat(
        F.lit("Property at "), (k + 1).cast("string"), F.lit(" "), letters(k), F.lit(" Avenue; PCN: "),
        F.col("parcel_number"), F.lit("; Just Value: "),
        F.regexp_replace("sale_price", r"\.[0-9]*$", ""),
        F.lit("; West Palm Beach; "), (k % 90).cast("string"), F.lit("."),
        (k % 10).cast("string"), F.lit(" acres; Mail "), letters(F.col("page_id")),
        F.lit(" TOWN, FL "), F.lpad((k % 100000).cast("string"), 5, "0"),
        F.lit("; Homestead: "), F.col("homesteaded"), F.lit("; Lot Size: "),
        F.col("square_footage"), F.lit(" sq ft"))


def text_lines(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    """``line_id, page_id, line_no, text``: one line per order."""
    return listing_rows(spark, sf_dir).select(
        F.col("order_key").alias("line_id"), "page_id", F.col("row_no").alias("line_no"),
        text.alias("text"))


def block_pages(spark: SparkSession, sf_dir: str, text: Column | None = None) -> DataFrame:
    """Pages with the rows as ``<div class="result">`` blocks, no results table."""
    item = F.concat(
        F.lit('<div class="result"><a href="/detail/parcel?id='),
        F.col("order_key").cast("string"), F.lit('">'),
        prose_text() if text is None else text, F.lit("</a></div>"))
    grouped = _by_page(listing_rows(spark, sf_dir), item)
    return _pages(grouped, F.array_join("items", "\n"))


def row_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose rows are marked cells with one compact line, each in a table of its own,
    after a row that is not marked."""
    item = F.concat(F.lit('<table><tr><td class="odd result"><a href="/detail/parcel?id='),
                    F.col("order_key").cast("string"), F.lit('">'),
                    F.regexp_replace(compact_text(), "&", "&amp;"), F.lit("</a></td></tr></table>"))
    grouped = _by_page(listing_rows(spark, sf_dir), item)
    return _pages(grouped, F.concat(
        F.lit("<table><tr><td>a</td><td>b</td><td>c</td></tr></table>"),
        F.array_join("items", "\n")))


def plain_table_pages(spark: SparkSession, sf_dir: str, headings: str) -> DataFrame:
    """Pages whose table has the given first row and street addresses with 'LN'."""
    cells = [F.col("sale_price"), F.col("sale_date"), F.col("owner_name"),
             F.regexp_replace("property_address", "CIR$", "LN"), F.col("municipality"),
             F.col("square_footage"), F.col("homesteaded"), F.col("parcel_number")]
    item = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells],
                    F.lit("</tr>"))
    grouped = _by_page(listing_rows(spark, sf_dir), item)
    return _pages(grouped, F.concat(
        F.lit(f"<table><tr>{headings}</tr>"), F.array_join("items", "\n"), F.lit("</table>")))


def fact_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose rows stand in plain text, one block each between blank lines."""
    grouped = _by_page(listing_rows(spark, sf_dir), facts_text())
    return _pages(grouped, F.concat(F.lit("\n\n"), F.array_join("items", "\n\n"), F.lit("\n\n")))
