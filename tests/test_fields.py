"""Header and cell rules, with the consequences of first match and last write."""

import pytest
from pyspark.sql import functions as F

from pagetables.functions import fields as K
from pagetables.operators import mapping
from pagetables.plans import extract

AT = "2024-01-02 03:04:05"

MAPPING = {
    "Sale Date": "sale_price", "Sold Date": "sale_price", "Date": "sale_date",
    "Mail Address": "property_address", "Mail City, State, Zip": "mail_address",
    "Assessed Value": "property_value", "Market Value": "property_value",
    "Land Use": "lot_size", "Building Class": "property_type", "Half Bath": "bathrooms",
    "School District": "neighborhood", "Homestead Exemption": "homesteaded", "Sq. Ft": None,
    "Owner Name": "owner_name", "Location": "property_address", "Municipality": "municipality",
    "Parcel Number": "parcel_number", "Acres": "acres", "Lot Size": "lot_size",
    "Zoning": "zoning", "Homestead": "homesteaded", "Year Built": "year_built",
    "Tax Amount": "tax_amount", "Subdivision": "subdivision",
}


@pytest.fixture
def headers(spark):
    return spark.createDataFrame([(h,) for h in MAPPING] + [("Sale Date",)], "header string")


def test_first_field_of_the_table_wins(headers):
    got = mapping.map_columns(headers).collect()
    assert {r["header"]: r["field"] for r in got} == MAPPING


def test_keyword_table_of_any_size_gives_the_same(spark, headers):
    table = spark.createDataFrame(
        [(rank, field, word) for rank, (field, words) in enumerate(K.FIELD_KEYWORDS)
         for word in words], "rank int, field string, keyword string")
    got = mapping.map_columns(headers, table).collect()
    assert len(got) == len(MAPPING) + 1
    assert {r["header"]: r["field"] for r in got} == MAPPING


def test_keywords_can_be_replaced(headers):
    got = mapping.map_columns(headers, [("a", ["sq."]), ("b", ["sale"])]).collect()
    assert {r["field"] for r in got} == {"a", "b", None}


def table(headings, *rows, cell="td"):
    head = "".join(f"<{cell}>{h}</{cell}>" for h in headings)
    body = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"


def sales(df):
    rows = extract.extract_sales(df, AT).orderBy("page_id", "table_idx", "row_idx").collect()
    keep = ["sale_price", "sale_date", "owner_name", "property_address", "municipality",
            "square_footage", "mail_address", "homesteaded", "parcel_number"]
    return [(r["page_id"], {k: r[k] for k in keep if r[k] is not None}) for r in rows]


def test_sales_by_header_and_value(pages):
    got = sales(pages(
        table(["Sale", "Sale", "Owner", "Location", "Mail Address", "Mail City"],
              ["$5", "1/2/2020", "Jo X", "1 A CIR", "2 B CIR", "Boca"]),
        table(["Owner", "Name", "Parcel"], ["Ann A", "", "7"], ["Ann B", "Bob C", "8"]),
        table(["Sale Price", "Homestead", "Sq Ft", "Extra"], ["none", "Y", "900"])))
    assert got == [
        (1, {"sale_price": "$5", "sale_date": "1/2/2020", "owner_name": "Jo X",
             "property_address": "2 B CIR", "municipality": "Boca"}),
        (2, {"owner_name": "Ann A", "parcel_number": "7"}),
        # the name that lost to the last column passes for a town in the pass over the cells
        (2, {"owner_name": "Bob C", "municipality": "Ann B", "parcel_number": "8"})]


def test_sales_by_position(pages):
    rows = [["$9", "Mar 3", "SMITH", "1 PINE AVE", "Lake Park", "1,500"],
            ["12345", "$8", "1 MAIN ST", "nowhere", "L1", "x"]]
    got = sales(pages(table([], *rows)))
    assert got == [
        (1, {"sale_price": "$9", "sale_date": "Mar 3", "owner_name": "SMITH",
             "property_address": "1 PINE AVE", "municipality": "Lake Park",
             "square_footage": "1,500"}),
        (1, {"sale_price": "$8", "property_address": "1 MAIN ST", "parcel_number": "12345",
             "square_footage": "12345"})]


@pytest.fixture
def filled(spark):
    def run(*cells, **given):
        start = F.struct(*[F.lit(given.get(n)).cast("string").alias(n) for n in K.HEADED_FIELDS])
        df = spark.createDataFrame([(list(cells),)], "x array<string>")
        row = df.select(K.fill_from_cells(start, F.col("x")).alias("r")).first()["r"]
        return {k: v for k, v in row.asDict().items() if v is not None}
    return run


def test_fill_from_cells(filled):
    assert filled("$5", "SMITH, JOHN", "1 OAK ST", "Lake Park", "1,200", "900") == {
        "sale_price": "$5", "owner_name": "SMITH, JOHN", "property_address": "1 OAK ST",
        "municipality": "Lake Park", "square_footage": "1,200"}
    # a long text that could be an owner is used up even if it is no name
    assert filled("lower case", "Boca") == {"municipality": "Boca"}
    # street tokens count inside words, so these are addresses, not towns or owners
    assert filled("West Palm Beach") == {"property_address": "West Palm Beach"}
    assert filled("EASTON") == {"property_address": "EASTON"}
    # a decimal or an area out of range is no square footage; the rest of the row is kept
    assert filled("1234.5", "499", "50001", "50,000", "$1") == {
        "square_footage": "50,000", "sale_price": "$1"}
    assert filled("$1", "$2 ST", sale_price="$0") == {
        "sale_price": "$0", "property_address": "$2 ST"}
    assert filled("Ann Lee", "Ann Lee", "Ann Roe") == {
        "owner_name": "Ann Lee", "municipality": "Ann Roe"}
    assert filled("", "ab", "x y") == {"municipality": "x y"}


def test_rows_of_sales_tables(pages):
    got = sales(pages("<table><tr><td>$1</td><td>a</td><td>b</td></tr></table>",
                      table(["A", "B", "C"], ["$1", "b"], ["$2", "b", "c"])))
    assert got == [(1, {"sale_price": "$1"}), (2, {"sale_price": "$2"})]


def test_fallbacks_of_sales(pages):
    df = pages(table(["A"], ["1", "2", "3"]) + "<div class=result>$1</div><div class=result>$2</div>",
               table(["A"], ["1", "2", "3"]) + "<p>Smith, John</p><p>$3</p>",
               table(["A"], ["1", "2", "3"]), "<div class=result>1</div><div class=result>2</div>")
    got = sales(df)
    assert [(p, r.get("sale_price"), r.get("owner_name")) for p, r in got] == [
        (1, "$1", None), (1, "$2", None), (2, "$3", "Smith, John")]


def wide(df, *fields):
    rows = extract.extract_wide(df, AT).orderBy("page_id", "table_idx", "row_idx").collect()
    return [tuple(r[f] for f in ("page_id", *fields)) for r in rows]


def test_wide_tables(pages):
    df = pages(
        table(["Owner", "Sale Price", "Sale Date"], ["Ann", "$1", "", "extra"], ["Bob", "$2"],
              cell="th"),
        table(["Owner", "Homestead"], ["Ann", "Y"], ["ANN", "N"], ["Bob"], ["", "Y"]))
    assert wide(df, "owner_name", "sale_price", "homesteaded") == [
        (1, "Ann", None, None), (1, "Bob", "$2", None), (2, "Ann", None, "Y"), (2, "Bob", None, None)]


def test_wide_rules_fill_empty_columns_and_compact_lines_override(pages):
    line = ("$100 2004-11-12 BACON JOHN &amp; 7 LAKE CIR TOWN 9068 7 LAKE CIR TOWN FL 33408 4 Y M")
    df = pages(table(["Owner", "Remarks"], ["Ann", "12-3456-789-0123 2 acres"], ["Bob", "PCN: 9"]),
               table(["Owner", "Remarks"], [line]))
    assert wide(df, "owner_name", "parcel_number", "acres", "sale_price") == [
        (1, "Ann", "12-3456-789-0123", "2", None), (1, "Bob", "9", None, None),
        (2, "BACON JOHN", None, None, "$100")]


def test_wide_text_keeps_the_start_of_the_block(pages):
    block = "Owner " + "x" * 400 + " PCN: 12-AB"
    got = wide(pages(f"<pre>short\n\n{block}\n \n{'y' * 60}</pre>"), "parcel_number",
               "additional_info")
    assert got == [(1, "12-AB", block[:300])]


def test_street_tokens_as_whole_words(pages):
    df = pages(table(list("ABC"), ["$1", "Smith John", "West Palm Beach"]),
               "<div class=result>in West Palm Beach, $1</div><div class=result>$2</div>")
    inside = extract.extract_sales(df, AT).orderBy("page_id", "row_idx").collect()
    whole = extract.extract_sales(df, AT, whole_word=True).orderBy("page_id", "row_idx").collect()
    assert (inside[0]["property_address"], inside[0]["municipality"]) == ("West Palm Beach", None)
    assert inside[1]["municipality"] != "West Palm Beach"
    assert [(r["property_address"], r["municipality"]) for r in whole][:2] == [
        (None, "West Palm Beach"), (None, "West Palm Beach")]
