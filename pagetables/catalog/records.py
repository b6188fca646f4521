"""Filters, extraction plans, de-duplication, sinks, streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from pagetables.catalog.base import (
    EXTRACTED_AT, FACTS, LINK, LISTED, PROSE, letters, nulls, query, work_dir,
)
from pagetables.catalog.fields import HEADED
from pagetables.catalog.rules import COMPACT_RECORD, SALES_SQL, first_of
from pagetables.functions.fixed import SALES_FIELDS, WIDE_FIELDS, WIDE_PATTERNS
from pagetables.operators import records as O
from pagetables.plans import extract, listing
from pagetables.sources import render, tables
from pagetables.streaming import stream

AT = datetime.fromisoformat(EXTRACTED_AT)


def sparse_rows(spark, sf_dir):
    """Listing rows with some fields blank."""
    rows = render.listing_rows(spark, sf_dir)
    blank = {"property_address": 2, "owner_name": 3, "parcel_number": 5, "sale_price": 7,
             "municipality": 11}
    return rows.withColumns({c: F.when(F.col("order_key") % m != 0, F.col(c)).otherwise("")
                             for c, m in blank.items()}).select("order_key", *blank)


SPARSE = LISTED + """, sparse AS (SELECT k AS order_key,
  CASE WHEN k % 2 <> 0 THEN property_address ELSE '' END AS property_address,
  CASE WHEN k % 3 <> 0 THEN owner_name ELSE '' END AS owner_name,
  CASE WHEN k % 5 <> 0 THEN parcel_number ELSE '' END AS parcel_number,
  CASE WHEN k % 7 <> 0 THEN sale_price ELSE '' END AS sale_price,
  CASE WHEN k % 11 <> 0 THEN municipality ELSE '' END AS municipality FROM base)
SELECT * FROM sparse WHERE property_address || owner_name"""


@query("fl1_keep_wide", SPARSE + " || parcel_number <> ''")
def keep_wide(spark, sf_dir):
    return O.keep_wide(sparse_rows(spark, sf_dir))


@query("fl2_keep_sales", SPARSE + " || sale_price || municipality || parcel_number <> ''")
def keep_sales(spark, sf_dir):
    return O.keep_sales(sparse_rows(spark, sf_dir))


@query("fl3_keep_text", SPARSE + " <> ''")
def keep_text(spark, sf_dir):
    return O.keep_text(sparse_rows(spark, sf_dir))


SALES_CORE = ["sale_price", "sale_date", "owner_name", "property_address", "municipality",
              "square_footage", "homesteaded", "parcel_number"]


def sales(spark, sf_dir):
    return extract.extract_sales(render.result_pages(spark, sf_dir), EXTRACTED_AT)


@query("fl4_search_records", LISTED + """
SELECT page_id, row_idx, sale_price, sale_date, property_address, municipality, square_footage
FROM shown WHERE municipality = 'CITY BA' AND CAST(square_footage AS INTEGER) >= 5000
  AND sold_at >= DATE '1995-01-01' AND CAST(substr(sale_price, 2) AS DECIMAL(18,2)) <= 400000""")
def search_records(spark, sf_dir):
    typed = O.typed_record(sales(spark, sf_dir))
    return O.search_records(typed, municipality="city ba", min_sqft=5000, date_from="1995-01-01",
                            max_value=400000).select(
        "page_id", "row_idx", "sale_price", "sale_date", "property_address", "municipality",
        "square_footage")


TERMS = ["widget", "ring red", "brand#1", "nothing here", "17"]


TYPED_HEADINGS = "".join(f"<th>{h}</th>" for h in (
    "Sale Price", "Day", "Owner Name", "Location", "Municipality", "Sq. Ft", "Type",
    "Parcel Number"))


@query("fl4_search_wide_type", LISTED + """
SELECT page_id, row_idx, owner_name, municipality, homesteaded AS property_type, parcel_number
FROM shown WHERE seat < 25 AND homesteaded = 'Y' AND municipality = 'CITY BC'""")
def search_wide_type(spark, sf_dir):
    pages = render.plain_table_pages(spark, sf_dir, TYPED_HEADINGS)
    return listing.search_wide(pages, EXTRACTED_AT, property_type=" y",
                               municipality="City BC").select(
        "page_id", "row_idx", "owner_name", "municipality", "property_type", "parcel_number")


@query("fl4_search_by_option", LISTED + f"""
, o AS (SELECT 'CITY ' || {letters('n_nationkey')} AS municipality,
   CASE n_name WHEN 'GERMANY' THEN 'germany' WHEN 'CHINA' THEN 'china' END AS term FROM nation)
SELECT term, page_id, row_idx, municipality, parcel_number FROM shown JOIN o USING (municipality)
WHERE term IS NOT NULL""")
def search_by_option(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    options = nation.select(
        F.col("n_nationkey").alias("pos"), F.concat(F.lit("City "), F.translate(
            F.col("n_nationkey").cast("string"), "0123456789", "ABCDEFGHIJ")).alias("text"),
        F.col("n_name").alias("value"))
    typed = O.typed_record(sales(spark, sf_dir))
    return O.search_by_option(typed, options, ["germany", "china"]).select(
        "term", "page_id", "row_idx", "municipality", "parcel_number")


@query("fl5_resolve_option", f"""
WITH t AS (SELECT unnest({TERMS}) AS term),
o AS (SELECT p_partkey AS pos, p_name AS text, p_brand AS value FROM part),
hits AS (SELECT term, o.*, CASE
    WHEN contains(lower(text), term) OR contains(lower(value), term) THEN 1
    WHEN list_bool_and([contains(lower(text), w) for w in string_split(term, ' ')])
      OR list_bool_and([contains(lower(value), w) for w in string_split(term, ' ')]) THEN 2
  END AS tier FROM t, o)
SELECT term, CAST(tier AS INTEGER) AS tier, pos, text, value FROM hits WHERE tier IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY term ORDER BY tier, pos) = 1""")
def resolve_option(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    options = part.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("text"),
                          F.col("p_brand").alias("value"))
    return O.resolve_option(options, TERMS)


WIDE_TABLE = {"sale_price": "sale_date", "owner_name": "owner_name",
              "property_address": "property_address", "municipality": "municipality",
              "homesteaded": "homesteaded", "parcel_number": "parcel_number",
              "record_url": LINK + " || '&v=1'", "extraction_date": f"'{EXTRACTED_AT}'"}


@query("cas1_extract_wide", LISTED + f"""
SELECT page_id, CAST(1 AS INTEGER) AS table_idx, row_idx, {nulls(WIDE_FIELDS, WIDE_TABLE)}
FROM shown WHERE seat < 25""")
def extract_wide(spark, sf_dir):
    return extract.extract_wide(render.result_pages(spark, sf_dir), EXTRACTED_AT).select(
        "page_id", "table_idx", "row_idx", *WIDE_FIELDS)


WIDE_ROWS = nulls(WIDE_FIELDS, {
    **{n: f"r.{n}" for n in ("sale_price", "sale_date", "owner_name", "property_address",
                             "municipality", "square_footage", "mail_address",
                             "mail_city_state_zip", "homesteaded")},
    "record_url": LINK, "extraction_date": f"'{EXTRACTED_AT}'"})


@query("cas1_extract_wide_rows", LISTED + f"""
, r AS (SELECT k, page_id, seat, {COMPACT_RECORD} FROM shown WHERE seat < 25)
SELECT page_id, CAST(seat + 1 AS INTEGER) AS table_idx, CAST(0 AS INTEGER) AS row_idx, {WIDE_ROWS}
FROM r""")
def extract_wide_rows(spark, sf_dir):
    return extract.extract_wide(render.row_pages(spark, sf_dir), EXTRACTED_AT).select(
        "page_id", "table_idx", "row_idx", *WIDE_FIELDS)


WIDE_TEXT = nulls(WIDE_FIELDS, {
    **{f: first_of(WIDE_PATTERNS[f]) for f in ("property_address", "parcel_number", "acres",
                                               "mail_city_state_zip", "lot_size")},
    "property_value": first_of(WIDE_PATTERNS["property_value"], prefix="$"),
    "municipality": "'Palm Beach'", "homesteaded": "CASE homesteaded WHEN 'Y' THEN 'Yes' ELSE 'No' END",
    "additional_info": "left(text, 300)", "extraction_date": f"'{EXTRACTED_AT}'"})


@query("cas1_extract_wide_text", LISTED + f"""
, lines AS (SELECT page_id, row_idx, homesteaded, {FACTS} AS text FROM shown WHERE seat < 25)
SELECT page_id, CAST(-1 AS INTEGER) AS table_idx, CAST(row_idx - 1 AS INTEGER) AS row_idx,
  {WIDE_TEXT} FROM lines""")
def extract_wide_text(spark, sf_dir):
    return extract.extract_wide(render.fact_pages(spark, sf_dir), EXTRACTED_AT).select(
        "page_id", "table_idx", "row_idx", *WIDE_FIELDS)


@query("cas1_extract_wide_text_long", LISTED + f"""
, lines AS (SELECT page_id // 3 AS g, seat, homesteaded, {FACTS} AS text,
    CAST(row_number() OVER (PARTITION BY page_id // 3 ORDER BY page_id, seat) - 1 AS INTEGER)
      AS row_idx FROM shown)
SELECT g AS page_id, CAST(-1 AS INTEGER) AS table_idx, row_idx, {WIDE_TEXT}
FROM lines WHERE seat < 25""")
def extract_wide_text_long(spark, sf_dir):
    """Three pages in one: more than 50 blocks on a page, all of them read."""
    long = render.fact_pages(spark, sf_dir).groupBy(F.floor(F.col("page_id") / 3).alias("g")).agg(
        F.min("url").alias("url"),
        F.sort_array(F.collect_list(F.struct("page_id", "html"))).alias("parts"))
    pages = long.select(F.col("g").alias("page_id"), "url", F.array_join(
        F.transform("parts", lambda p: p["html"]), "").alias("html"))
    return extract.extract_wide(pages, EXTRACTED_AT).select(
        "page_id", "table_idx", "row_idx", *WIDE_FIELDS)


SALES_TABLE = {**HEADED, "record_url": LINK + " || '&v=1'",
               "extraction_date": f"'{EXTRACTED_AT}'", "page_number": "page_no"}


@query("cas2_extract_sales", LISTED + f"""
SELECT page_id, CAST(1 AS INTEGER) AS table_idx, row_idx, {nulls(SALES_FIELDS, SALES_TABLE)}
FROM shown""")
def extract_sales(spark, sf_dir):
    return sales(spark, sf_dir).select("page_id", "table_idx", "row_idx", *SALES_FIELDS)


SALES_BLOCK = nulls(SALES_FIELDS, {
    **SALES_SQL, "record_url": LINK, "extraction_date": f"'{EXTRACTED_AT}'",
    "page_number": "page_no"})


@query("cas2_extract_sales_blocks", LISTED + f"""
, lines AS (SELECT k, page_id, page_no, row_idx, {PROSE} AS text FROM shown)
SELECT page_id, CAST(-1 AS INTEGER) AS table_idx, CAST(row_idx - 1 AS INTEGER) AS row_idx,
  {SALES_BLOCK} FROM lines""")
def extract_sales_blocks(spark, sf_dir):
    return extract.extract_sales(render.block_pages(spark, sf_dir), EXTRACTED_AT).select(
        "page_id", "table_idx", "row_idx", *SALES_FIELDS)


@query("uni1_union_pages", LISTED + """
SELECT kind, count(*) AS n_records, count(DISTINCT sale_price || '|' || seat || page_id) AS n_rows
FROM shown, (SELECT unnest(['block', 'table']) AS kind) GROUP BY kind""")
def union_pages(spark, sf_dir):
    kinds = [("table", render.result_pages), ("block", render.block_pages)]
    both = [make(spark, sf_dir).withColumn("kind", F.lit(kind)) for kind, make in kinds]
    records = extract.extract_sales(both[0].unionByName(both[1]), EXTRACTED_AT)
    return records.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.countDistinct("page_id", "table_idx", "row_idx").alias("n_rows"))


@query("ded1_dedupe_first", LISTED + """
SELECT page_id, row_idx, property_address, owner_name FROM shown WHERE seat < 25""")
def dedupe_first(spark, sf_dir):
    return O.dedupe_first(sales(spark, sf_dir)).select(
        "page_id", "row_idx", "property_address", "owner_name")


@query("ded1_dedupe_all", """
SELECT o_custkey % 7 AS parcel, min(o_orderkey) AS page_id FROM orders GROUP BY ALL""")
def dedupe_all(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("page_id"), F.lit(0).alias("table_idx"),
        F.lit(0).alias("row_idx"), F.lit(None).cast("string").alias("property_address"),
        F.lit("").alias("owner_name"), (F.col("o_custkey") % 7).alias("parcel"),
        (F.col("o_custkey") % 7).cast("string").alias("parcel_number"))
    return O.dedupe_first(orders, scope="all").select("parcel", "page_id")


@query("lim1_sample", LISTED + f"""
SELECT page_id, CAST(1 AS INTEGER) AS table_idx, row_idx, property_address, owner_name,
  square_footage, municipality, sale_price, sale_date, left({LINK} || '&v=1', 60) AS record_url,
  CAST(NULL AS VARCHAR) AS year_built, CAST(NULL AS VARCHAR) AS property_value
FROM shown ORDER BY page_id, row_idx LIMIT 2""")
def sample(spark, sf_dir):
    return O.sample(sales(spark, sf_dir), url_chars=60)


def texts(names, given, blank="''"):
    return ", ".join(f"{given.get(n, blank)} AS {n}" for n in names)


@query("snk1_write_sales_csv", LISTED + f"""
SELECT {texts(SALES_FIELDS, {**SALES_TABLE, 'page_number': 'CAST(page_no AS VARCHAR)'})}
FROM shown""")
def write_sales_csv(spark, sf_dir):
    path = tables.scratch_path(spark, "sales-csv", work_dir(spark))
    tables.write_sales_csv(sales(spark, sf_dir), path)
    return tables.read_csv(spark, path)


@query("snk2_write_wide_csv", LISTED + f"""
SELECT {texts(WIDE_FIELDS, WIDE_TABLE)} FROM shown WHERE seat < 25""")
def write_wide_csv(spark, sf_dir):
    path = tables.scratch_path(spark, "wide-csv", work_dir(spark))
    records = extract.extract_wide(render.result_pages(spark, sf_dir), EXTRACTED_AT)
    tables.write_wide_csv(records, path, ordered=True, work_dir=work_dir(spark))
    return tables.read_csv(spark, path).toDF(*WIDE_FIELDS)


@query("snk3_write_json", LISTED + f"""
SELECT {texts(WIDE_FIELDS, WIDE_TABLE)} FROM shown WHERE seat < 25""")
def write_json(spark, sf_dir):
    path = tables.scratch_path(spark, "json", work_dir(spark))
    records = extract.extract_wide(render.result_pages(spark, sf_dir), EXTRACTED_AT)
    tables.write_json(records, path)
    return spark.read.schema(", ".join(f"{f} string" for f in WIDE_FIELDS)).json(path)


@query("snk4_write_run", LISTED + f"""
SELECT {texts(SALES_CORE, HEADED)}, '20240102_030405' AS run_ts FROM shown""")
def write_run(spark, sf_dir):
    folder = tables.write_run(sales(spark, sf_dir), tables.scratch_path(spark, "runs", work_dir(spark)), AT)
    return spark.read.parquet(folder).select(*SALES_CORE, "run_ts")


@query("snk5_empty_result", f"""
SELECT '{",".join(SALES_FIELDS)}' AS header, CAST(0 AS BIGINT) AS n_records""")
def empty_result(spark, sf_dir):
    """The header survives and the file reads back with its schema and without records."""
    path = tables.scratch_path(spark, "empty", work_dir(spark))
    found = O.search_records(sales(spark, sf_dir), municipality="nowhere")
    tables.write_sales_csv(found, path)
    read = tables.read_csv(spark, path)
    lines = spark.read.text(path).select(F.col("value").alias("header")).distinct()
    return lines.join(read.select(*SALES_FIELDS).agg(F.count(F.lit(1)).alias("n_records")),
                      F.length("header") > 0)


def stored_pages(spark, sf_dir):
    """Rendered pages as files in a folder, for the streams."""
    folder = tables.scratch_path(spark, "arriving", work_dir(spark))
    pages = render.result_pages(spark, sf_dir)
    pages.write.parquet(folder)
    return folder, pages.schema


@query("snk6_incremental_save", LISTED + f"""
SELECT page_id, row_idx, {texts(SALES_CORE, HEADED)} FROM shown""")
def incremental_save(spark, sf_dir):
    folder, schema = stored_pages(spark, sf_dir)
    arriving = stream.read_pages_stream(
        spark, folder, schema, files_per_batch=50, partitions=tables.work_partitions(spark))
    records = extract.extract_sales(arriving, EXTRACTED_AT).select(
        "page_id", "row_idx", *SALES_CORE)
    out = tables.scratch_path(spark, "saved", work_dir(spark))
    stream.append_records(records, f"{out}/data", f"{out}/log").awaitTermination()
    return spark.read.schema(records.schema).parquet(f"{out}/data")


@query("str1_dedupe_stream", LISTED + """
SELECT DISTINCT property_address, parcel_number, owner_name FROM shown""")
def dedupe_stream(spark, sf_dir):
    folder, schema = stored_pages(spark, sf_dir)
    arriving = stream.read_pages_stream(spark, folder, schema, partitions=tables.work_partitions(spark))
    records = extract.extract_sales(arriving, EXTRACTED_AT)
    first = stream.dedupe_stream(records, unbounded_state=True)
    return saved(spark, first.select("property_address", "parcel_number", "owner_name"))


def saved(spark, first):
    out = tables.scratch_path(spark, "distinct", work_dir(spark))
    stream.append_records(first, f"{out}/data", f"{out}/log").awaitTermination()
    return spark.read.schema(first.schema).parquet(f"{out}/data")


@query("str1_dedupe_stream_watermark", LISTED + """
SELECT DISTINCT page_id, property_address, parcel_number, owner_name, sale_price FROM shown""")
def dedupe_stream_watermark(spark, sf_dir):
    """Copies within a page are whole, so the surviving record can be told."""
    folder, schema = stored_pages(spark, sf_dir)
    arriving = stream.read_pages_stream(
        spark, folder, schema, files_per_batch=50, partitions=tables.work_partitions(spark))
    records = extract.extract_sales(arriving, EXTRACTED_AT).withColumn(
        "arrived", F.col("extraction_date").cast("timestamp"))
    first = stream.dedupe_stream(records, scope="page", arrival="arrived")
    return saved(spark, first.select("page_id", "property_address", "parcel_number",
                                     "owner_name", "sale_price"))

