"""Listing runs: which stored pages belong to a run, and their records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.operators.records import search_records, typed_record
from pagetables.operators.scan import mark_pages
from pagetables.operators.sequence import (
    current_page_of, next_link_of, number_pages, total_pages_of, visit_limits, with_run_limit,
)
from pagetables.operators.structure import page_readiness
from pagetables.plans.extract import extract_wide, records_of_pages, sales_records
from pagetables.sources.tables import materialise


def page_facts(pages: DataFrame, records: bool = False, whole_word: bool = False) -> DataFrame:
    """One row per page: ``source, page_id, url, page_no, total_pages, has_next, n_records``;
    with ``records`` also the sales records. Columns the pages already have are kept; a page
    that shows no number has a NULL ``page_no``, see ``number_pages``."""
    staged = mark_pages(pages)
    page, url = F.col("marked"), F.col("url")
    if "page_no" not in pages.columns:
        staged = staged.withColumn("page_no", current_page_of(page, url))
    if "total_pages" not in pages.columns:
        staged = staged.withColumn("total_pages", total_pages_of(page))
    staged = staged.withColumn("has_next", next_link_of(page, F.col("page_no")).isNotNull())
    found = sales_records(staged, whole_word).withColumn("n_records", F.size("records"))
    return found if records else found.drop("records")


def run_listing(pages: DataFrame, extracted_at, source: str = "source",
                max_pages: int | None = None, empty_run: int | None = None,
                without_next: bool = False, whole_word: bool = False, ready_only: bool = False,
                work_dir: str | None = None) -> DataFrame:
    """Sales records of all pages of each run, numbered: pages whose ``page_no`` is NULL get
    their position in the run by ``page_id``.

    The rules that bound a visit are applied only if asked for: ``max_pages`` (and then the
    total that the pages show), ``empty_run`` empty pages in a row, the first page
    ``without_next`` link. ``ready_only`` leaves out pages that were stored while loading.

    Pages are parsed once: facts and records are written to ``work_dir`` (by default the
    folder of ``spark.checkpoint.dir``), the rules read the narrow columns only, and the
    records are filtered by one limit per run.
    """
    if ready_only:
        pages = page_readiness(pages).filter(F.col("readiness") != "loading").drop("readiness")
    facts = materialise(page_facts(pages, records=True, whole_word=whole_word), "facts", work_dir)
    facts = number_pages(facts, source)
    if max_pages is not None or empty_run is not None or without_next:
        known = facts if max_pages is not None else facts.withColumn(
            "total_pages", F.lit(None).cast("int"))
        limits = visit_limits(known, source, max_pages, empty_run, without_next)
        facts = with_run_limit(facts, limits, source).filter(
            (F.col("page_no") >= F.col("first_page"))
            & (F.col("last_page").isNull() | (F.col("page_no") <= F.col("last_page")))).drop(
            "first_page", "last_page")
    return records_of_pages(facts.drop("has_next", "n_records"), extracted_at)


def search_listing(pages: DataFrame, extracted_at, source: str = "source",
                   max_pages: int | None = None, empty_run: int | None = None,
                   without_next: bool = False, whole_word: bool = False,
                   ready_only: bool = False, work_dir: str | None = None, **criteria) -> DataFrame:
    """Typed sales records of the visited pages that meet the criteria. Sales records hold
    no property type; ``search_wide`` searches by it."""
    if criteria.get("property_type") is not None:
        raise ValueError("sales records hold no property_type; use search_wide")
    return search_records(typed_record(run_listing(
        pages, extracted_at, source, max_pages, empty_run, without_next, whole_word,
        ready_only, work_dir)), **criteria)


def search_wide(pages: DataFrame, extracted_at, keywords=None, **criteria) -> DataFrame:
    """Typed wide records of all pages that meet the criteria, the property type too."""
    return search_records(typed_record(extract_wide(pages, extracted_at, keywords)), **criteria)
