"""What a page is: its structure, whether it is ready, whether it has a pager."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.functions import html as H
from pagetables.functions.fixed import DETAIL_LINK_WORDS
from pagetables.functions.text import contains_any, let
from pagetables.operators.scan import is_results_table, mark_pages, result_row_units


def has_pagination_mark(html):
    """Some text says Next or Page, or some class contains page. Script text counts, as it
    is part of the page's elements."""
    return let(H.marked(html, hidden=H.COMMENT), lambda page: (
        contains_any(H.stored_text(page), ["Next", "Page"])
        | page.rlike(rf"(?s){H.OPEN}[a-zA-Z]{H.attribute_contains('class', 'page')}")))


def has_pagination(pages: DataFrame) -> DataFrame:
    """``has_pagination`` of each page."""
    return pages.withColumn("has_pagination", has_pagination_mark(F.col("html"))).drop("html")


def page_structure(pages: DataFrame) -> DataFrame:
    """One row per page: counts of tables, rows, links, and the structure type they lead
    to with its expected number of results. Narrow: the counts are taken in the row."""
    staged = pages.withColumn("has_pagination", has_pagination_mark(F.col("html")))
    staged = mark_pages(staged).withColumn("_all_tables", H.tables(F.col("marked")))
    staged = staged.withColumn("_table_rows", F.filter(F.transform(
        "_all_tables", lambda t: F.when(is_results_table(t, F.size(H.rows(t))),
                                       F.size(H.rows(t)))), lambda n: n.isNotNull()))
    staged = staged.withColumn("_n_rows", F.size(result_row_units(F.col("_all_tables"))))
    staged = staged.withColumn("_n_links", F.size(F.filter(
        H.tags(F.col("marked")), lambda t: t["tag"].rlike(r"(?i)^a\b") & contains_any(
            H.attribute(t["tag"], "href"), DETAIL_LINK_WORDS))))
    keys = [c for c in pages.columns if c not in ("html", "marked")]
    expected = F.aggregate("_table_rows", F.lit(0), lambda acc, n: acc + n - 1)
    return staged.select(
        *keys,
        F.size("_table_rows").alias("n_results_tables"),
        F.col("_n_rows").alias("n_result_rows"),
        F.col("_n_links").alias("n_detail_links"),
        "has_pagination",
        F.when(F.size("_table_rows") > 0, "table").when(F.col("_n_rows") > 0, "rows")
        .otherwise("text_based").alias("structure_type"),
        F.when(F.size("_table_rows") > 0, expected).otherwise(F.col("_n_rows"))
        .alias("total_results"))


def page_readiness(pages: DataFrame) -> DataFrame:
    """``readiness``: loading, ready, empty or pending; the first that holds."""
    page = F.col("marked")
    loading = (page.rlike(rf"(?s)(?i:{H.OPEN}div)\b[^{H.SHUT}]*{H.SHUT}[^{H.OPEN}]*Loading")
               | page.rlike(rf"(?s){H.OPEN}[a-zA-Z]"
                            + H.attribute_contains("class", "loading|spinner")))
    data_row = F.exists(H.tables(page), lambda t: F.exists(
        H.rows(t), lambda r: r.rlike(rf"(?i){H.OPEN}td\b")))
    nothing = contains_any(H.stored_text(page), ["No records", "No results"])
    return mark_pages(pages).withColumn(
        "readiness", F.when(loading, "loading").when(data_row, "ready")
        .when(nothing, "empty").otherwise("pending")).drop("marked")


def is_results_page(pages: DataFrame, address_part: str | None = None) -> DataFrame:
    """``title`` and ``is_results_page``: URL or title speak of search results. With
    ``address_part`` only a URL containing it counts (the strict form)."""
    staged = mark_pages(pages).withColumn("title", H.title(F.col("marked"))).drop("marked")
    if address_part is not None:
        return staged.withColumn("is_results_page", F.contains("url", F.lit(address_part)))
    return staged.withColumn(
        "is_results_page",
        contains_any(F.lower("url"), ["search", "result"])
        | contains_any(F.lower("title"), ["search", "result", "property"]))
