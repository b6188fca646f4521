"""Scalar functions and header mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetables.catalog.base import EXTRACTED_AT, LISTED, nulls, query
from pagetables.functions import fields as K
from pagetables.functions import text as T
from pagetables.functions.fixed import FIELD_KEYWORDS
from pagetables.operators import mapping
from pagetables.operators import scan as S
from pagetables.plans import extract
from pagetables.operators.records import typed_record
from pagetables.catalog.base import EXTRACTED_AT
from pagetables.sources import render


@query("fn1_clean_text", """
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text,
   '[\\s\\x{00A0}\\x{0085}\\x{000B}\\p{Z}]+', ' ', 'g'),
   '^[:\\- ]+|[:\\- ]+$', '', 'g'), '\\$ *([0-9])', '$\\1', 'g') AS clean FROM documents""")
def clean_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", T.clean_text(F.col("text")).alias("clean"))


@query("fn1_clean_text_cells", LISTED + """
SELECT k AS line_id, sale_price || ' x: ' || owner_name AS clean FROM base""")
def clean_text_cells(spark, sf_dir):
    rows = render.listing_rows(spark, sf_dir)
    dirty = F.concat(F.lit(" : $ "), F.substring("sale_price", 2, 30), F.lit(" \t x: "),
                     F.col("owner_name"), F.lit(" - :"))
    return rows.select(F.col("order_key").alias("line_id"), T.clean_text(dirty).alias("clean"))


@query("fn2_extraction_date", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS extraction_date FROM events""")
def extraction_date(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", T.extraction_date(F.col("ts")).alias("extraction_date"))


@query("fn3_truncate_info", "SELECT doc_id, left(text, 300) AS additional_info FROM documents")
def truncate_info(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", T.truncate_info(F.col("text")).alias("additional_info"))


FIRST_MATCH_RULES = ["([0-9]{4})", "([a-z]+tion)", "([A-Z][a-z]+)"]


@query("fn4_first_match", f"""
SELECT doc_id, coalesce(CASE WHEN lang = 'en' THEN lang END,
  {", ".join(f"nullif(regexp_extract(text, '{p}', 1), '')" for p in FIRST_MATCH_RULES)})
  AS found FROM documents""")
def first_match(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    current = F.when(F.col("lang") == "en", F.col("lang"))
    return docs.select("doc_id", T.first_match(
        current, F.col("text"), FIRST_MATCH_RULES, ignore_case=False).alias("found"))


FLAGS = ["Y", "n", "Homestead Exemption", "no", "YES", "maybe"]


@query("fn5_normalise_yes_no", f"""
SELECT o_orderkey, ['Yes', 'No', 'Yes', 'No', 'Yes', 'MAYBE'][o_orderkey % {len(FLAGS)} + 1]
  AS homesteaded FROM orders""")
def normalise_yes_no(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    raw = F.get(F.array(*[F.lit(f) for f in FLAGS]),
                (F.col("o_orderkey") % len(FLAGS)).cast("int"))
    return orders.select("o_orderkey", T.yes_no(raw).alias("homesteaded"))


@query("fn6_page_progress", LISTED + """
SELECT page_id, round(page_no / 60.0 * 100, 1)::DOUBLE AS progress FROM paged""")
def page_progress(spark, sf_dir):
    return render.result_pages(spark, sf_dir).select("page_id", T.page_progress(
        F.col("page_no"), F.col("total_pages")).alias("progress"))


@query("fn7_typed_record", LISTED + """
SELECT page_id, row_idx, CAST(substr(sale_price, 2) AS DECIMAL(18,2)) AS sale_price_num,
       CAST(sold_at AS DATE) AS sale_date_value,
       CAST(square_footage AS INTEGER) AS square_footage_int,
       homesteaded = 'Y' AS homesteaded_flag FROM shown""")
def typed(spark, sf_dir):
    records = extract.extract_sales(render.result_pages(spark, sf_dir), EXTRACTED_AT)
    return typed_record(records).select(
        "page_id", "row_idx", "sale_price_num", "sale_date_value", "square_footage_int",
        "homesteaded_flag")


@query("fn8_numeric_text", LISTED + """
SELECT page_id, row_idx, col_idx,
       regexp_matches(translate([sale_price, square_footage, homesteaded, parcel_number]
         [col_idx + 1], ',.', ''), '^[0-9]+$') AS is_numeric
FROM shown, (SELECT CAST(unnest(range(4)) AS INTEGER) AS col_idx)""")
def numeric_text(spark, sf_dir):
    cells = S.explode_cells(S.data_rows_wide(S.explode_rows(S.explode_tables(
        render.result_pages(spark, sf_dir)))))
    at = F.element_at(F.create_map(*[F.lit(v) for pair in [(0, 0), (5, 1), (6, 2), (7, 3)]
                                     for v in pair]), F.col("col_idx"))
    return cells.filter(F.col("col_idx").isin(0, 5, 6, 7)).select(
        "page_id", "row_idx", at.alias("col_idx"),
        T.numeric_text(F.col("text")).alias("is_numeric"))


KEYWORD_VALUES = ", ".join(f"({rank}, '{field}', '{word}')"
                           for rank, (field, words) in enumerate(FIELD_KEYWORDS)
                           for word in words)


@query("map1_map_columns", LISTED + f"""
, k (rank, field, keyword) AS (VALUES {KEYWORD_VALUES}),
h AS (SELECT page_id, CAST(i - 1 AS INTEGER) AS col_idx, ['sale price', 'sale date', 'owner name',
   'location', 'municipality', 'sq. ft', 'homestead', 'parcel number'][i] AS header
   FROM paged, (SELECT unnest(range(1, 9)) AS i) WHERE NOT is_empty)
SELECT page_id, col_idx, header, (SELECT arg_min(field, rank) FROM k
  WHERE contains(header, keyword)) AS field FROM h""")
def map_columns(spark, sf_dir):
    headers = S.table_headers(render.result_pages(spark, sf_dir)).filter("n_rows > 1")
    return mapping.map_columns(headers).select("page_id", "col_idx", "header", "field")


@query("map1_custom_fields", LISTED + """
SELECT page_id, row_idx, owner_name, square_footage AS area_note, homesteaded FROM shown
WHERE seat < 25""")
def custom_fields(spark, sf_dir):
    """A keyword table with a field of its own: the column is there and filled."""
    keywords = [*FIELD_KEYWORDS, ("area_note", ["sq. ft"])]
    return extract.extract_wide(render.result_pages(spark, sf_dir), EXTRACTED_AT, keywords).select(
        "page_id", "row_idx", "owner_name", "area_note", "homesteaded")


@query("map1_map_columns_table", """
WITH words AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS keyword FROM part),
k AS (SELECT keyword, 'has ' || keyword AS field, md5(keyword) AS rank FROM words)
SELECT p_partkey, header, arg_min(field, rank) AS field
FROM (SELECT p_partkey, p_name || ' ' || p_brand AS header FROM part)
LEFT JOIN k ON contains(lower(header), keyword) GROUP BY p_partkey, header""")
def map_columns_table(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    words = part.select(F.explode(F.split("p_name", " ")).alias("keyword")).distinct()
    ranked = words.select(F.md5(F.col("keyword").cast("binary")).alias("rank"),
                          F.concat(F.lit("has "), "keyword").alias("field"), "keyword")
    headers = part.select("p_partkey", F.concat("p_name", F.lit(" "), "p_brand").alias("header"))
    return mapping.map_columns(headers, ranked).select("p_partkey", "header", "field")


def data_rows(pages):
    return S.data_rows_sales(S.explode_rows(S.explode_tables(pages)))


@query("map2_assign_mapped", LISTED + f"""
SELECT page_id, row_idx, {nulls(K.MAPPED_FIELDS, {
    "sale_price": "sale_date", "owner_name": "owner_name",
    "property_address": "property_address", "municipality": "municipality",
    "homesteaded": "homesteaded", "parcel_number": "parcel_number"})} FROM shown""")
def assign_mapped(spark, sf_dir):
    rows = data_rows(render.result_pages(spark, sf_dir))
    return mapping.assign_mapped(rows).select("page_id", "row_idx", *K.MAPPED_FIELDS)


HEADED = {n: n for n in ("sale_price", "sale_date", "owner_name", "property_address",
                         "municipality", "square_footage", "homesteaded", "parcel_number")}


@query("map3_assign_by_header_and_value", LISTED + f"""
SELECT page_id, row_idx, {nulls(K.HEADED_FIELDS, HEADED)} FROM shown""")
def assign_by_header_and_value(spark, sf_dir):
    rows = data_rows(render.result_pages(spark, sf_dir))
    return mapping.assign_by_header_and_value(rows).select(
        "page_id", "row_idx", *K.HEADED_FIELDS)


LANE = {**HEADED, "property_address": "regexp_replace(property_address, 'CIR$', 'LN')"}


@query("map4_assign_by_position", LISTED + f"""
SELECT page_id, row_idx, {nulls(K.HEADED_FIELDS, {
    k: v for k, v in LANE.items() if k not in ("homesteaded", "parcel_number")})} FROM shown""")
def assign_by_position(spark, sf_dir):
    rows = data_rows(render.plain_table_pages(spark, sf_dir, headings=""))
    return mapping.assign_by_header_and_value(rows).select(
        "page_id", "row_idx", *K.HEADED_FIELDS)


@query("map5_fill_from_cells", LISTED + f"""
SELECT page_id, row_idx, {nulls(K.HEADED_FIELDS, {
    k: v for k, v in LANE.items()
    if k not in ("homesteaded", "parcel_number", "sale_date")})} FROM shown""")
def fill_from_cells(spark, sf_dir):
    rows = data_rows(render.plain_table_pages(spark, sf_dir, headings="".join(
        f"<th>{h}</th>" for h in "ABCDEFGH")))
    return mapping.assign_by_header_and_value(rows, fill=True).select(
        "page_id", "row_idx", *K.HEADED_FIELDS)
