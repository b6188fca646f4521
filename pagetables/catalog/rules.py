"""Text rules on rendered lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetables.catalog.base import FACTS, LISTED, PROSE, query
from pagetables.functions import html as H
from pagetables.functions import rules as R
from pagetables.functions.fixed import WIDE_PATTERNS
from pagetables.functions.text import no_text
from pagetables.operators.scan import mark_pages
from pagetables.sources import render

FACT_LINES = LISTED + f", lines AS (SELECT k AS line_id, page_id, {FACTS} AS text FROM base)\n"
PROSE_LINES = LISTED + f", lines AS (SELECT k AS line_id, page_id, {PROSE} AS text FROM base)\n"


def fact_lines(spark, sf_dir):
    return render.text_lines(spark, sf_dir, render.facts_text())


def prose_lines(spark, sf_dir):
    return render.text_lines(spark, sf_dir, render.prose_text())


def first_of(patterns, group=1, flags="i", prefix=""):
    parts = [f"nullif(trim(regexp_extract(text, '{p}', {group}, '{flags}')), '')" for p in patterns]
    return "coalesce(" + ", ".join(f"'{prefix}' || {p}" if prefix else p for p in parts) + ")"


def _wide(name, field, sql):
    @query(name, FACT_LINES + f"SELECT line_id, {sql} AS {field} FROM lines")
    def run(spark, sf_dir):
        return fact_lines(spark, sf_dir).select("line_id", R.WIDE_RULES[field](
            no_text(), F.col("text")).alias(field))


_wide("rw1_property_address", "property_address", first_of(WIDE_PATTERNS["property_address"]))
_wide("rw2_parcel_number", "parcel_number", first_of(WIDE_PATTERNS["parcel_number"]))
_wide("rw3_property_value", "property_value", first_of(WIDE_PATTERNS["property_value"],
                                                       prefix="$"))
_wide("rw4_municipality", "municipality",
      "CASE WHEN contains(lower(text), 'palm beach') THEN 'Palm Beach' END")
_wide("rw5_acres", "acres", first_of(WIDE_PATTERNS["acres"]))
_wide("rw6_mail_city_state_zip", "mail_city_state_zip",
      first_of(WIDE_PATTERNS["mail_city_state_zip"]))
_wide("rw7_homesteaded", "homesteaded",
      f"CASE upper({first_of(WIDE_PATTERNS['homesteaded'])}) WHEN 'Y' THEN 'Yes' "
      "WHEN 'YES' THEN 'Yes' WHEN 'HOMESTEAD EXEMPTION' THEN 'Yes' WHEN 'N' THEN 'No' "
      "WHEN 'NO' THEN 'No' END")
_wide("rw8_lot_size", "lot_size", first_of(WIDE_PATTERNS["lot_size"]))

COMPACT_RECORD = """sale_price, sale_date, owner_name, property_address, municipality,
  square_footage, property_address AS mail_address,
  municipality || ' FL ' || lpad(CAST(k % 100000 AS VARCHAR), 5, '0') AS mail_city_state_zip,
  CASE WHEN homesteaded = 'Y' THEN 'Yes' ELSE 'No' END AS homesteaded"""


@query("rw9_parse_compact", LISTED + f"SELECT k AS line_id, {COMPACT_RECORD} FROM base")
def parse_compact(spark, sf_dir):
    lines = render.text_lines(spark, sf_dir, render.compact_text())
    return lines.select("line_id", R.parse_compact(F.col("text")).alias("r")).select(
        "line_id", "r.*")


FOUND = """[x for x in regexp_extract_all(text, '\\b([1-9]\\d{2,4})\\b', 1)
            if CAST(x AS INTEGER) BETWEEN 500 AND 50000][1]"""
SALES_SQL = {
    "sale_price": "regexp_extract(text, '\\$[\\d,]+\\.?\\d*', 0)",
    "sale_date": first_of(["\\b\\d{1,2}/\\d{1,2}/\\d{4}\\b", "\\b\\d{1,2}-\\d{1,2}-\\d{4}\\b",
                           "\\b\\d{4}-\\d{1,2}-\\d{1,2}\\b"], 0, "c"),
    "property_address": first_of(
        ["\\b\\d+\\s+[A-Za-z\\s]+(St|Street|Ave|Avenue|Blvd|Boulevard|Rd|Road|Ln|Lane|Ct|Court"
         "|Dr|Drive|Way|Pl|Place)\\b"], 0),
    "owner_name": "regexp_extract(text, '\\b[A-Z][a-z]+,\\s*[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*\\b')",
    "municipality": "regexp_extract(text, '\\b(Palm Beach|West Palm Beach|Boca Raton|Delray Beach"
                    "|Boynton Beach|Wellington|Jupiter|Lake Worth)\\b', 0)",
    "square_footage": FOUND,
    "parcel_number": first_of(["\\b[A-Z0-9]{2,3}-[0-9]{2,4}-[0-9]{2,4}\\b"], 0, "c"),
    "homesteaded": "regexp_extract(text, '\\b(Y|N|Yes|No|TRUE|FALSE)\\b', 0, 'i')",
}
ALONE = {
    "sale_price": R.sales_price, "sale_date": R.sales_date,
    "property_address": R.sales_address,
    "owner_name": lambda c, t: R.sales_owner(c, t, no_text(), no_text()),
    "municipality": lambda c, t: R.sales_municipality(c, t, no_text(), no_text()),
    "square_footage": R.sales_square_footage, "parcel_number": R.sales_parcel,
    "homesteaded": R.sales_homestead,
}


def _sales(name, field):
    @query(name, PROSE_LINES + f"SELECT line_id, {SALES_SQL[field]} AS {field} FROM lines")
    def run(spark, sf_dir):
        return prose_lines(spark, sf_dir).select("line_id", ALONE[field](
            no_text(), F.col("text")).alias(field))


for number, rule in enumerate(["sale_price", "sale_date", "property_address", "owner_name",
                               "municipality", "square_footage", "parcel_number",
                               "homesteaded"], 1):
    _sales(f"rs{number}_{rule}", rule)

# The first line fills every field, so a page's record is that of its first row; an empty
# page says 'No records found' and shows its pager.
FOLD_SQL = PROSE_LINES + f""", firsts AS (
  SELECT l.page_id, text FROM lines l JOIN shown ON k = line_id AND shown.page_id = l.page_id
  WHERE seat = 0)
SELECT page_id, {", ".join(f"{sql} AS {f}" for f, sql in SALES_SQL.items())} FROM firsts"""


@query("rs9_fold_lines", FOLD_SQL)
def fold_lines(spark, sf_dir):
    pages = mark_pages(render.block_pages(spark, sf_dir)).filter(~F.contains(
        "marked", F.lit("No records")))
    record = R.fold_lines(H.text_lines(H.body_text(F.col("marked"))))
    return pages.select("page_id", record.alias("r")).select("page_id", "r.*")


RULES = [("parcel_number", 1, r"PCN[:\s]*([A-Z0-9\-]+)", 1, "{}"),
         ("property_value", 2, r"Total Value[:\s]*\$([0-9,]+)", 1, "total ${}"),
         ("property_value", 1, r"Just Value[:\s]*\$([0-9,]+)", 1, "${}"),
         ("zip", 1, r"FL ([0-9]{5})", 1, "{}")]


@query("fill_from_patterns", FACT_LINES + """
SELECT line_id, regexp_extract(text, 'PCN: ([A-Z0-9\\-]+)', 1) AS parcel_number,
  '$' || regexp_extract(text, 'Just Value: \\$([0-9,]+)', 1) AS property_value,
  CASE WHEN line_id % 2 = 0 THEN 'kept' ELSE regexp_extract(text, 'FL ([0-9]{5})', 1) END AS zip
FROM lines""")
def fill_from_patterns(spark, sf_dir):
    lines = fact_lines(spark, sf_dir).withColumn(
        "zip", F.when(F.col("line_id") % 2 == 0, "kept"))
    return R.fill_from_patterns(lines, "text", RULES).select(
        "line_id", "parcel_number", "property_value", "zip")

