"""Extraction plans: pages to records.

Both plans are one narrow pass over the pages: tables, fallbacks and page-wise
de-duplication are worked out inside the row of a page, so there is no shuffle, each page
is parsed once, and the same plan runs on a stream. A page is one input row; nothing is
gathered over pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.functions import fields as K
from pagetables.functions import html as H
from pagetables.functions import rules as R
from pagetables.functions.fixed import SALES_FIELDS, WIDE_FIELDS
from pagetables.functions.text import (
    built_once, clean_text, extraction_date, let, no_text, truncate_info,
)
from pagetables.operators.scan import (
    blocks_of_text, explode_array, is_results_table, mark_pages, result_row_units,
)

SALES_KEEP = ["sale_price", "property_address", "owner_name", "municipality", "parcel_number"]
WIDE_KEEP = ["property_address", "owner_name", "parcel_number"]
TEXT_KEEP = ["property_address", "owner_name"]


def any_set(record, names):
    """Some of the named fields is set."""
    return F.coalesce(*[record[n] for n in names]).isNotNull()


# --- sales records -----------------------------------------------------------------


def _sales_struct(table_idx, row_idx, record, href, names):
    given = {n: record[n] for n in names}
    return F.struct(
        table_idx.cast("int").alias("table_idx"), row_idx.cast("int").alias("row_idx"),
        *[given.get(n, no_text()).alias(n) for n in K.HEADED_FIELDS], href.alias("href"))


def sales_row_record(roles, texts, whole_word=False):
    """Record of a row: by headings, or by position where there are none, then filled
    from the cells."""
    start = F.when(F.size(roles) > 0, K.assign_by_header_and_value(roles, texts)).otherwise(
        K.assign_by_position(texts, whole_word))
    return K.fill_from_cells(start, texts, whole_word)


def _sales_from_tables(tables, whole_word=False):
    def of_rows(rows, i):
        single = F.size(rows) == 1
        data = F.when(single, rows).otherwise(F.slice(rows, 2, F.size(rows)))
        first = F.when(single, 0).otherwise(1)
        roles = K.header_roles(H.header_cells(F.get(rows, F.lit(0))))
        return let(roles, lambda header: F.transform(
            data, lambda r, j: F.struct(
                i.alias("table_idx"), (j + first).alias("row_idx"), header.alias("roles"),
                H.data_cells(r).alias("texts"), H.first_href(r).alias("href"))))

    units = F.flatten(F.transform(tables, lambda t, i: let(
        H.rows(t), lambda rows: F.when(F.size(rows) > 0, of_rows(rows, i)).otherwise(
            F.array().cast("array<struct<table_idx:int,row_idx:int,roles:array<struct<"
                           "price:boolean,date:boolean,other:string>>,texts:array<string>,"
                           "href:string>>")))))
    records = F.transform(
        F.filter(units, lambda u: F.size(u["texts"]) >= 3),
        lambda u: let(sales_row_record(u["roles"], u["texts"], whole_word), lambda r: _sales_struct(
            u["table_idx"], u["row_idx"], r, u["href"], K.HEADED_FIELDS)))
    return F.filter(records, lambda r: any_set(r, SALES_KEEP))


def _sales_from_blocks(blocks, whole_word=False):
    records = F.transform(blocks, lambda b, i: let(
        let(H.inner_text(b), lambda text: R.sales_record(R.empty_sales(), text, whole_word)),
        lambda r: _sales_struct(F.lit(-1), i, r, H.first_href(b), R.SALES_TEXT_FIELDS)))
    return F.filter(records, lambda r: any_set(r, SALES_KEEP))


def _sales_from_text(page, whole_word=False):
    record = let(R.fold_lines(H.text_lines(H.body_text(page)), whole_word), lambda r: _sales_struct(
        F.lit(-1), F.lit(0), r, no_text(), R.SALES_TEXT_FIELDS))
    return F.filter(F.array(record), lambda r: any_set(r, TEXT_KEEP))


@built_once
def _table_column(whole_word):
    return _sales_from_tables(H.tables(F.col("marked")), whole_word)


@built_once
def _block_column(whole_word):
    return _sales_from_blocks(H.result_blocks(F.col("marked"), F.col("_kind")), whole_word)


@built_once
def _text_column(whole_word):
    return _sales_from_text(F.col("marked"), whole_word)


@built_once
def _wide_column(more=()):
    return _dedupe_in_page(_wide_records(F.col("_units"), more))


def own_fields(keywords) -> tuple[str, ...]:
    """Fields of a keyword table beyond the built-in ones, in the order of the table."""
    return tuple(dict.fromkeys(f for f, _ in keywords or () if f not in WIDE_FIELDS))


def sales_records(pages: DataFrame, whole_word: bool = False) -> DataFrame:
    """Pages with ``records``: from tables; where these give none, from result blocks;
    where these give none, one record from the text."""
    staged = mark_pages(pages)
    staged = staged.withColumn("_from_tables", _table_column(whole_word))
    staged = staged.withColumn("_kind", F.when(
        F.size("_from_tables") == 0, H.result_kind(F.col("marked"))))
    staged = staged.withColumn("_from_blocks", _block_column(whole_word))
    return staged.withColumn(
        "records", F.when(F.size("_from_tables") > 0, F.col("_from_tables"))
        .when(F.size("_from_blocks") > 0, F.col("_from_blocks"))
        .otherwise(_text_column(whole_word))) \
        .drop("marked", "_from_tables", "_from_blocks", "_kind")


def extract_sales(pages: DataFrame, extracted_at, whole_word: bool = False) -> DataFrame:
    """Sales records of all pages, with ``page_id``, ``table_idx``, ``row_idx`` and the
    other page columns; ``page_no`` of the page, if any, becomes ``page_number``.
    Street tokens count inside words ('WEST' holds 'ST') unless ``whole_word``."""
    return records_of_pages(sales_records(pages, whole_word), extracted_at)


def records_of_pages(found: DataFrame, extracted_at) -> DataFrame:
    """Pages with ``records`` to one row per sales record."""
    keys = [c for c in found.columns if c != "records"]
    rows = explode_array(found, keys, F.col("records"), "pos", "r")
    page_number = F.col("page_no").cast("int") if "page_no" in keys else F.lit(None).cast("int")
    given = {n: F.col(f"r.{n}") for n in K.HEADED_FIELDS}
    given["record_url"] = H.resolve_url(F.col("r.href"), F.col("url"))
    given["extraction_date"] = extraction_date(extracted_at)
    given["page_number"] = page_number
    return rows.select(*keys, "r.table_idx", "r.row_idx",
                       *[given.get(n, no_text()).alias(n) for n in SALES_FIELDS])


# --- wide records ------------------------------------------------------------------

WIDE_UNIT = "array<struct<table_idx:int,row_idx:int,fields:array<string>,fragment:string>>"


def _wide_unit(table_idx, row_idx, fields, fragment):
    return F.struct(table_idx.cast("int").alias("table_idx"), row_idx.cast("int").alias("row_idx"),
                    fields.alias("fields"), fragment.alias("fragment"))


def _wide_table_units(results, keywords):
    def of_rows(rows, i):
        return let(K.fields_of_headers(H.header_cells(F.get(rows, F.lit(0))), keywords),
                   lambda fields: F.transform(
                       F.slice(rows, 2, F.size(rows)),
                       lambda r, j: _wide_unit(i, j + 1, fields, r)))

    units = F.flatten(F.transform(results, lambda t: let(
        H.rows(t["table"]), lambda rows: of_rows(rows, t["table_idx"]))))
    return F.filter(units, lambda u: H.data_cell_count(u["fragment"]) > 0)


def _wide_records(units, more=()):
    no_fields = F.array().cast("array<string>")

    def record(u):
        is_text = u["table_idx"] < 0
        text = F.when(is_text, u["fragment"]).otherwise(H.inner_text(u["fragment"]))
        texts = F.when(F.size(u["fields"]) > 0, F.transform(
            H.data_cells(u["fragment"]), clean_text)).otherwise(no_fields)
        mapped = let(texts, lambda t: K.assign_mapped(
            u["fields"], t, [*K.MAPPED_FIELDS, *more]))
        return let(mapped, lambda m: let(text, lambda x: let(
            R.wide_record(m, x, K.MAPPED_FIELDS), lambda r: F.struct(
                u["table_idx"].alias("table_idx"), u["row_idx"].alias("row_idx"),
                *[r[n].alias(n) for n in K.MAPPED_FIELDS], *[m[n].alias(n) for n in more],
                F.when(~is_text, H.first_href(u["fragment"])).alias("href"),
                F.when(is_text, truncate_info(u["fragment"])).alias("additional_info")))))

    return F.filter(F.transform(units, record), lambda r: any_set(r, WIDE_KEEP))


def _dedupe_in_page(records):
    """First record of each key; sorts, so the cost is n log n in the page's records."""
    def key(r):
        return F.concat_ws("|", F.lower(F.trim(F.coalesce(r["property_address"], F.lit("")))),
                           F.trim(F.coalesce(r["parcel_number"], F.lit(""))),
                           F.lower(F.trim(F.coalesce(r["owner_name"], F.lit("")))))

    keyed = F.array_sort(F.transform(records, lambda r, i: F.struct(
        key(r).alias("key"), i.alias("i"), r.alias("r"))))
    return let(keyed, lambda k: F.transform(
        F.filter(k, lambda x, i: (i == 0) | (x["key"] != F.get(k, i - 1)["key"])),
        lambda x: x["r"]))


def wide_records(pages: DataFrame, keywords=None, block_limit: int | None = None) -> DataFrame:
    """Pages with ``structure_type`` and ``records``: by structure from results tables,
    result rows or text blocks (``block_limit`` of a page at most, if given); per page the
    first record of each key. Fields that only ``keywords`` has are filled from columns."""
    more = own_fields(keywords)
    keywords = keywords or K.FIELD_KEYWORDS
    none = F.array().cast("array<string>")
    staged = mark_pages(pages).withColumn("_all_tables", H.tables(F.col("marked")))
    staged = staged.withColumn("_results", F.filter(
        F.transform("_all_tables", lambda t, i: F.struct(i.alias("table_idx"), t.alias("table"))),
        lambda t: is_results_table(t["table"], F.size(H.rows(t["table"])))))
    staged = staged.withColumn("_result_rows", F.when(
        F.size("_results") == 0, result_row_units(F.col("_all_tables"))))
    staged = staged.withColumn(
        "structure_type", F.when(F.size("_results") > 0, "table")
        .when(F.size("_result_rows") > 0, "rows").otherwise("text_based"))
    units = (F.when(F.col("structure_type") == "table",
                    _wide_table_units(F.col("_results"), keywords).cast(WIDE_UNIT))
             .when(F.col("structure_type") == "rows", F.transform(
                 "_result_rows", lambda r: _wide_unit(
                     r["table_idx"], r["row_idx"], none, r["row"])).cast(WIDE_UNIT))
             .otherwise(F.transform(
                 blocks_of_text(H.stored_text(F.col("marked")), block_limit),
                 lambda b, i: _wide_unit(F.lit(-1), i, none, b)).cast(WIDE_UNIT)))
    staged = staged.withColumn("_units", units)
    return staged.withColumn("records", _wide_column(more)) \
        .drop("marked", "_all_tables", "_results", "_result_rows", "_units")


def extract_wide(pages: DataFrame, extracted_at, keywords=None,
                 block_limit: int | None = None) -> DataFrame:
    """Wide records of all pages, with ``page_id``, ``table_idx``, ``row_idx`` and the
    other page columns. ``keywords`` replaces the header keyword table; fields of its own
    become columns after the others. All text blocks of a page are read unless
    ``block_limit`` is given."""
    found = wide_records(pages, keywords, block_limit)
    keys = [c for c in found.columns if c not in ("records", "structure_type")]
    rows = explode_array(found, keys, F.col("records"), "pos", "r")
    given = {n: F.col(f"r.{n}") for n in K.MAPPED_FIELDS}
    given["record_url"] = H.resolve_url(F.col("r.href"), F.col("url"))
    given["additional_info"] = F.col("r.additional_info")
    given["extraction_date"] = extraction_date(extracted_at)
    return rows.select(*keys, "r.table_idx", "r.row_idx",
                       *[given.get(n, no_text()).alias(n) for n in WIDE_FIELDS],
                       *[F.col(f"r.{n}").alias(n) for n in own_fields(keywords)])
