"""Page -> table -> row -> cell: the scan of stored pages.

``pages`` is any DataFrame with ``page_id``, ``url`` and ``html``; its other columns are
kept. Every operator here is narrow: one ``Generate`` or ``Project`` over the pages, no
shuffle, so the input partitioning decides the parallelism.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetables.functions import html as H
from pagetables.functions.fixed import (
    BLOCK_MIN_CHARS, DETAIL_LINK_WORDS, RESULT_ROW_TEXT, RESULTS_TABLE_WORDS,
    TEXT_BLOCK_SPLIT, TEXT_BLOCK_WORDS,
)
from pagetables.functions.text import contains_any, let, strip


def mark_pages(pages: DataFrame) -> DataFrame:
    """Replace ``html`` by ``marked`` text, done once for all that follows."""
    if "marked" in pages.columns:
        return pages
    return pages.withColumn("marked", H.marked(F.col("html"))).drop("html")


def explode_array(df: DataFrame, keys: list[str], array: Column, pos: str, item: str) -> DataFrame:
    """``posexplode`` without the optimizer's extra "not empty" filter, which would work
    out the array a second time below the projection that builds it."""
    return df.select(*keys, F.posexplode_outer(array).alias(pos, item)).filter(
        F.col(pos).isNotNull())


def explode_tables(pages: DataFrame) -> DataFrame:
    """One row per table: ``table_idx``, ``table`` fragment, ``n_rows``."""
    marked = mark_pages(pages)
    keys = [c for c in marked.columns if c != "marked"]
    return explode_array(marked, keys, H.tables(F.col("marked")), "table_idx", "table") \
        .withColumn("n_rows", F.size(F.split("table", rf"(?i){H.OPEN}tr\b")) - 1)


def explode_rows(tables: DataFrame) -> DataFrame:
    """One row per table row: ``row_idx``, ``row`` fragment, ``n_td``, and the ``headers``
    of its table."""
    keys = [c for c in tables.columns if c != "table"]
    split = tables.withColumn("rows", H.rows(F.col("table")))
    headed = split.withColumn("headers", F.when(
        F.size("rows") > 0, H.header_cells(F.get("rows", F.lit(0)))))
    return explode_array(headed, [*keys, "headers"], F.col("rows"), "row_idx", "row") \
        .withColumn("n_td", H.data_cell_count(F.col("row")))


def explode_cells(rows: DataFrame) -> DataFrame:
    """One row per cell: ``col_idx``, ``is_header``, ``text``, ``href``."""
    keys = [c for c in rows.columns if c not in ("row", "headers")]
    pieces = explode_array(rows, keys, H.cell_pieces(F.col("row")), "col_idx", "piece")
    return pieces.select(
        *keys, "col_idx",
        (H.cell_kind(F.col("piece")) == "th").alias("is_header"),
        H.cell_text(F.col("piece")).alias("text"),
        H.first_href(F.concat(F.lit(H.OPEN), F.col("piece"))).alias("href"))


def table_headers(pages: DataFrame) -> DataFrame:
    """One row per header cell of each table: ``col_idx``, ``header``."""
    tables = explode_tables(pages)
    keys = [c for c in tables.columns if c != "table"]
    first = tables.withColumn("first_row", F.get(H.rows(F.col("table")), F.lit(0)))
    return explode_array(first, keys, H.header_cells(F.col("first_row")), "col_idx", "header")


def data_rows_wide(rows: DataFrame) -> DataFrame:
    """Rows after the first that have a td."""
    return rows.filter((F.col("n_rows") >= 2) & (F.col("row_idx") >= 1) & (F.col("n_td") > 0))


def data_rows_sales(rows: DataFrame) -> DataFrame:
    """Rows after the first, or the only row, with at least three td."""
    return rows.filter(((F.col("row_idx") >= 1) | (F.col("n_rows") == 1)) & (F.col("n_td") >= 3))


def is_results_table(table, n_rows):
    return (n_rows > 1) & contains_any(F.lower(H.stored_text(table)), RESULTS_TABLE_WORDS)


def results_tables(tables: DataFrame) -> DataFrame:
    return tables.filter(is_results_table(F.col("table"), F.col("n_rows")))


def result_row_units(tables):
    """Per page: the marked result rows of all tables, else all rows with three td, as
    array<struct<table_idx, row_idx, row>>."""
    rows = F.flatten(F.transform(tables, lambda t, i: F.transform(
        H.rows(t), lambda r, j: F.struct(
            i.alias("table_idx"), j.alias("row_idx"), r.alias("row")))))
    is_marked = rf"(?s)(?i:{H.OPEN}td)\b{H.attribute_contains('class', 'result')}"
    town_cell = rf"(?s)(?i:{H.OPEN}td)\b[^{H.SHUT}]*{H.SHUT}[^{H.OPEN}]*{RESULT_ROW_TEXT}"
    return let(rows, lambda all_rows: let(
        F.filter(all_rows, lambda r: r["row"].rlike(is_marked) | r["row"].rlike(town_cell)),
        lambda found: F.when(F.size(found) > 0, found).otherwise(
            F.filter(all_rows, lambda r: H.data_cell_count(r["row"]) >= 3))))


def result_rows(pages: DataFrame) -> DataFrame:
    """One row per result row: ``table_idx``, ``row_idx``, ``text``, ``href``."""
    marked = mark_pages(pages)
    keys = [c for c in marked.columns if c != "marked"]
    units = explode_array(
        marked, keys, result_row_units(H.tables(F.col("marked"))), "pos", "u")
    return units.select(*keys, "u.table_idx", "u.row_idx",
                        H.inner_text(F.col("u.row")).alias("text"),
                        H.first_href(F.col("u.row")).alias("href"))


def result_blocks(pages: DataFrame) -> DataFrame:
    """One row per result block: ``kind``, ``block_idx``, ``text``, ``href``."""
    marked = mark_pages(pages).withColumn("kind", H.result_kind(F.col("marked")))
    keys = [c for c in marked.columns if c != "marked"]
    blocks = explode_array(marked, keys, H.result_blocks(
        F.col("marked"), F.col("kind")), "block_idx", "block")
    return blocks.select(*keys, "block_idx", H.inner_text(F.col("block")).alias("text"),
                         H.first_href(F.col("block")).alias("href"))


def first_link(rows: DataFrame) -> DataFrame:
    """``record_url``: absolute URL of the first link of each row."""
    return rows.withColumn("record_url", H.resolve_url(
        H.first_href(F.col("row")), F.col("url")))


def links(pages: DataFrame) -> DataFrame:
    """One row per link of a page: ``pos``, ``href``, ``text``."""
    marked = mark_pages(pages)
    keys = [c for c in marked.columns if c != "marked"]
    anchors = explode_array(marked, keys, F.filter(
        H.tags(F.col("marked")), lambda t: t["tag"].rlike(r"(?i)^a\b")), "pos", "a")
    return anchors.select(*keys, "pos", H.attribute(F.col("a.tag"), "href").alias("href"),
                          F.col("a.text").alias("text"))


def detail_links(pages: DataFrame) -> DataFrame:
    """Links whose href names a property, parcel or detail page."""
    return links(pages).filter(contains_any(F.col("href"), DETAIL_LINK_WORDS)).drop("text")


def page_text(pages: DataFrame, layout: bool = False) -> DataFrame:
    """``text`` of each page: as stored, or as laid out (body only)."""
    marked = mark_pages(pages)
    text = H.body_text if layout else H.stored_text
    return marked.withColumn("text", text(F.col("marked"))).drop("marked")


def blocks_of_text(text, limit: int | None = None):
    """The blocks of a text that are long enough and name a property word; with ``limit``
    the first of them."""
    trimmed = F.transform(F.split(text, TEXT_BLOCK_SPLIT), strip)
    wanted = F.filter(trimmed, lambda b: (F.length(b) > BLOCK_MIN_CHARS)
                      & contains_any(F.lower(b), TEXT_BLOCK_WORDS))
    return wanted if limit is None else F.slice(wanted, 1, limit)


def text_blocks(pages: DataFrame, limit: int | None = None) -> DataFrame:
    texts = page_text(pages)
    keys = [c for c in texts.columns if c != "text"]
    return explode_array(texts, keys, blocks_of_text(F.col("text"), limit), "block_idx", "block")


def text_lines(pages: DataFrame) -> DataFrame:
    texts = page_text(pages, layout=True)
    keys = [c for c in texts.columns if c != "text"]
    return explode_array(texts, keys, H.text_lines(F.col("text")), "line_no", "line")
