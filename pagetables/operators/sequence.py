"""Page sequences: which pages belong to a listing run, in which order, up to where.

A run (``source``) may hold a large share of all pages, so nothing here sorts or gathers a
whole run in one task: limits per run are partially aggregated, positions and running
totals are built from buckets between quantiles of the page numbers, and per-run limits
meet the pages in a plain join, which Spark broadcasts if the limits are few and splits
where a run is large.

``facts`` are rows of one page each: ``source, page_no`` and, where a rule needs them,
``n_records, has_next, total_pages``. The rules read them several times, so facts that come
from extraction should be stored first (``materialise``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetables.functions import html as H
from pagetables.functions.fixed import (
    EMPTY_RUN, MAX_PAGE_NUMBER, MAX_PAGES, PAGE_OF, PAGE_SLASH,
)
from pagetables.functions.text import find, find_all, let
from pagetables.operators.scan import mark_pages
from pagetables.sources.tables import materialise

#: A line that is a page count: up to two words, a number, a slash, a number.
PAGE_SLASH_LINE = r"^(?:[a-z]+:?\s+){0,2}\d{1,4}\s*/\s*(\d{1,4})$"
BUCKET = 10_000
#: Quantiles of a run that its buckets are cut at.
QUANTILES = 1000


def page_number_range(number: Column, most: int | None = MAX_PAGE_NUMBER) -> Column:
    """``number`` as an integer if it is a plausible page number, else NULL. Texts of links
    are plausible up to ``most``; None leaves the upper end open."""
    n = number.try_cast("int")
    return F.when(n >= 1 if most is None else n.between(1, most), n)


# --- per page ------------------------------------------------------------------------

PAGER = (rf"(?s)^[a-zA-Z][a-zA-Z0-9]*\b(?:{H.attribute_contains('class', 'pagination|pager')}"
         rf"|{H.attribute_contains('id', 'pagination')})")


def _pagers(page: Column) -> Column:
    """Fragments of the pagination containers."""
    return F.when(page.rlike("pagination|pager"), H.elements(
        page, F.lit("[a-z][a-z0-9]*"), F.lit(PAGER))).otherwise(
        F.array().cast("array<string>"))


def _shown_in_pagers(page: Column, pattern: str, group: int) -> Column:
    """First number that a pagination container shows in the given form."""
    return F.get(F.filter(F.transform(_pagers(page), lambda c: find(
        H.body_text(c), pattern, group, ignore_case=True).try_cast("int")),
        lambda n: n.isNotNull()), F.lit(0))


def _outside_tables(page: Column) -> Column:
    """Text of a page without its tables: what a data cell says is no page count."""
    return H.body_text(F.regexp_replace(
        page, rf"(?is){H.OPEN}table\b.*?(?:{H.OPEN}/table\b[^{H.SHUT}]*{H.SHUT}|$)", " "))


def _fraction_lines(page: Column) -> Column:
    """Total of the first line outside tables that holds nothing but a fraction, with a word
    or two before it ('1/15', 'at 1/15', 'Page 1/15'). A fraction within a sentence or before a
    word, such as a share of a property, is none."""
    lines = F.transform(F.split(_outside_tables(page), r"\n"), F.trim)
    return F.get(F.filter(F.transform(lines, lambda line: find(
        line, PAGE_SLASH_LINE, 1, ignore_case=True).try_cast("int")), lambda n: n.isNotNull()), F.lit(0))


def total_pages_of(page: Column) -> Column:
    """Total shown on a page: 'X of Y' or 'X/Y' (no date) in a pagination container, 'X of Y'
    outside tables, 'X/Y' outside tables on a line of its own, else the highest page number
    among the links and in the containers."""
    links = F.array_max(F.transform(
        F.filter(H.tags(page), lambda t: t["tag"].rlike(r"(?i)^a\b")
                 & t["text"].rlike("^[0-9]{1,3}$")),
        lambda t: page_number_range(t["text"])))
    pagers = F.array_max(F.transform(
        F.flatten(F.transform(_pagers(page), lambda c: find_all(
            H.inner_text(c), r"\b(\d+)\b", 1))), lambda n: page_number_range(n)))
    return F.coalesce(
        _shown_in_pagers(page, PAGE_OF, 2), _shown_in_pagers(page, PAGE_SLASH, 2),
        find(_outside_tables(page), PAGE_OF, 2, ignore_case=True).try_cast("int"),
        F.when(F.contains(page, F.lit("/")), _fraction_lines(page)),
        F.greatest(links, pagers))


def current_page_of(page: Column, url: Column) -> Column:
    """Page number marked as current, else shown as 'X of Y', else in the URL."""
    is_current = H.attribute_contains("class", "current|active")

    def numbered(tags, name):
        return F.get(F.filter(F.transform(
            F.filter(tags, lambda t: t["text"].rlike("^[0-9]{1,4}$")
                     & t["tag"].rlike(rf"(?i)^{name}\b") & t["tag"].rlike(rf"(?s)^{is_current}")),
            lambda t: page_number_range(t["text"])), lambda n: n.isNotNull()), F.lit(0))

    item = F.get(F.filter(F.transform(
        F.when(page.rlike(rf"(?s)(?i:{H.OPEN}li)\b{is_current}"), H.elements(
            page, F.lit("li"), F.lit(rf"(?s)^(?i:li)\b{is_current}"))),
        lambda li: page_number_range(find(
            li, rf"{H.OPEN}a\b[^{H.SHUT}]*{H.SHUT}\s*(\d+)\s*{H.OPEN}/a", 1, ignore_case=True))),
        lambda n: n.isNotNull()), F.lit(0))
    in_pager = F.get(F.filter(F.transform(
        _pagers(page), lambda c: numbered(H.tags(c), "[a-z]")), lambda n: n.isNotNull()), F.lit(0))
    return F.coalesce(
        let(H.tags(page), lambda t: F.coalesce(numbered(t, "span"), numbered(t, "a"))),
        item, in_pager,
        _shown_in_pagers(page, PAGE_OF, 1),
        find(_outside_tables(page), PAGE_OF, 1, ignore_case=True).try_cast("int"),
        page_number_range(F.regexp_extract(url, r"[?&]page=([0-9]+)", 1), None))


def next_link_of(page: Column, page_no: Column) -> Column:
    """struct(rank, pos, href) of the best link to the next page, NULL if there is none."""
    return let((page_no + 1).cast("string"), lambda following: _next_link(page, following))


def _next_link(page: Column, following: Column) -> Column:
    def attr(t, name, word):
        return t["tag"].rlike(rf"(?s)^{H.attribute_contains(name, word)}")

    def candidate(tags, t, i):
        def named(name):
            return t["tag"].rlike(rf"(?i)^{name}\b")
        off = t["tag"].rlike(r"(?i)^(?:button|input)\b.*\bdisabled\b")
        more, arrow = F.contains(t["text"], F.lit("Next")), F.contains(t["text"], F.lit(">"))
        titled = F.contains(t["tag"], F.lit("Next Page")) & (
            H.attribute(t["tag"], "title").eqNullSafe(F.lit("Next Page")))
        says_next = F.contains(t["tag"], F.lit("next"))
        rank = (F.when(off, None)
                .when(more & named("a"), 1).when(more & named("button"), 2)
                .when(named("input") & attr(t, "value", "Next"), 3)
                .when(arrow & named("a"), 4).when(arrow & named("button"), 5)
                .when((t["text"] == following) & named("a"), 6)
                .when(titled & named("a"), 7)
                .when(says_next & attr(t, "class", "next"), 8)
                .when(says_next & attr(t, "id", "next"), 9))
        # an element marked as next may hold the link instead of being it
        inner = F.get(tags, i + 1)["tag"]
        href = F.coalesce(H.attribute(t["tag"], "href"), F.when(
            rank.isin(8, 9) & inner.rlike(r"(?i)^a\b"), H.attribute(inner, "href")))
        return let(rank, lambda r: F.when(r.isNotNull(), F.struct(
            r.alias("rank"), i.alias("pos"), href.alias("href"))))

    return let(H.tags(page), lambda tags: F.array_min(F.transform(
        tags, lambda t, i: candidate(tags, t, i))))


def total_pages(pages: DataFrame) -> DataFrame:
    """``total_pages`` of each page, NULL where none is shown."""
    return mark_pages(pages).withColumn(
        "total_pages", total_pages_of(F.col("marked"))).drop("marked")


def current_page(pages: DataFrame, source: str | None = None) -> DataFrame:
    """``page_no`` of each page; with ``source`` a page that shows none gets its position
    in the run by ``page_id``."""
    staged = mark_pages(pages).withColumn(
        "page_no", current_page_of(F.col("marked"), F.col("url"))).drop("marked")
    if source is None:
        return staged
    return number_pages(staged, source)


def number_pages(pages: DataFrame, source: str) -> DataFrame:
    """Give pages whose ``page_no`` is NULL their position in the run by ``page_id``. Only
    these pages meet their positions; the others keep what they have."""
    placed = positions(pages.select(source, "page_id", "page_no"), source, "page_id").filter(
        "page_no is null").select("page_id", F.col("pos").cast("int").alias("_pos"))
    return pages.join(placed, "page_id", "left").withColumn(
        "page_no", F.coalesce("page_no", "_pos")).drop("_pos")


def next_link(pages: DataFrame) -> DataFrame:
    """``next_rank`` (1-9, NULL for none) and ``next_url`` of each page."""
    staged = mark_pages(pages)
    if "page_no" not in pages.columns:
        staged = staged.withColumn("page_no", current_page_of(F.col("marked"), F.col("url")))
    staged = staged.withColumn("n", next_link_of(F.col("marked"), F.col("page_no")))
    return staged.withColumn("next_rank", F.col("n.rank")) \
        .withColumn("next_url", H.resolve_url(F.col("n.href"), F.col("url"))) \
        .drop("marked", "n")


def follow_next(pages: DataFrame) -> DataFrame:
    """``next_page_id``: the stored page that the next link leads to, the first one if the
    address is stored more than once. Pages without a link, or with one that is no web
    address (script links are alike on all pages), get a key of their own, so that they are
    not gathered under one."""
    linked = next_link(pages).withColumn("_key", F.coalesce(
        F.when(F.col("next_url").rlike("(?i)^https?://"), F.col("next_url")),
        F.concat(F.lit("no link "), F.col("page_id").cast("string"))))
    targets = pages.groupBy(F.col("url").alias("_key")).agg(
        F.min("page_id").alias("next_page_id"))
    return linked.join(targets, "_key", "left").drop("_key")


# --- per run: positions and totals ------------------------------------------------------

def in_buckets(df: DataFrame, source: str, order: str, bucket: int = BUCKET) -> DataFrame:
    """``_b``: number of the row's bucket in its source.

    Each source is cut at quantiles of ``order`` into about one bucket per ``bucket`` rows
    (of more than ``QUANTILES`` buckets neighbours are merged), so that numbers far from the
    others do not gather the rest in one bucket.
    """
    at = F.col(order).cast("double")
    quantiles = [i / QUANTILES for i in range(1, QUANTILES)]
    cuts = df.groupBy(source).agg(
        F.percentile_approx(at, quantiles, QUANTILES * 10).alias("_all"),
        F.least(F.ceil(F.count(F.lit(1)) / bucket), F.lit(QUANTILES)).cast("int").alias("_n"))
    # at most one source for each ``bucket`` rows is cut; the others need no row here
    cuts = cuts.filter("_n > 1").select(source, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.col("_n") - 1),
        lambda i: F.get("_all", (i * QUANTILES / F.col("_n")).cast("int") - 1))).alias("_cuts"))
    steps = F.lit([2 ** i for i in reversed(range((QUANTILES - 1).bit_length()))])
    passed = F.aggregate(steps, F.lit(0), lambda n, step: F.when(  # cuts rise, so halving finds how many are below
        F.get("_cuts", n + step - 1) < at, n + step).otherwise(n))
    return df.join(F.broadcast(cuts), source, "left") \
        .withColumn("_b", F.coalesce(passed, F.lit(0))).drop("_cuts")


def running_total(df: DataFrame, source: str, order: str, value: Column, name: str,
                  bucket: int = BUCKET) -> DataFrame:
    """``name``: sum of ``value`` over the rows of a source up to this one by ``order``, a
    number that is unique in the source.

    Sums are taken per bucket, and only the bucket sums are ordered over a whole source.
    """
    staged = in_buckets(df, source, order, bucket).withColumn("_v", value)
    sums = staged.groupBy(source, "_b").agg(F.sum("_v").alias("_s"))
    earlier = Window.partitionBy(source).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(source, "_b", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_o"))
    within = Window.partitionBy(source, "_b").orderBy(order).rowsBetween(
        Window.unboundedPreceding, 0)
    return staged.join(offsets, [source, "_b"]) \
        .withColumn(name, F.col("_o") + F.sum("_v").over(within)).drop("_b", "_v", "_o")


def positions(df: DataFrame, source: str = "source", order: str = "page_no",
              bucket: int = BUCKET) -> DataFrame:
    """``pos``: 1, 2, .. within the source by ``order``, whatever gaps the numbers have."""
    return running_total(df, source, order, F.lit(1), "pos", bucket)


def with_run_limit(df: DataFrame, limits: DataFrame, source: str) -> DataFrame:
    """Left join of one row per source. Spark broadcasts the limits if they are few; else
    they have a shuffle of their own, without which Spark could not split the rows of a
    large source, whose limit is a single row."""
    return df.join(limits.repartition(F.hash(F.col(source))), source, "left")


# --- per run: where to stop --------------------------------------------------------------

def page_limits(facts: DataFrame, source: str = "source", max_pages: int = MAX_PAGES) -> DataFrame:
    """First and last page number of each run: its first page, and the smaller of
    ``max_pages`` and the total it shows."""
    return facts.groupBy(source).agg(
        F.min("page_no").alias("first_page"),
        F.least(F.lit(max_pages), F.max("total_pages")).alias("last_page"))


def page_limit(facts: DataFrame, source: str = "source", max_pages: int = MAX_PAGES) -> DataFrame:
    limited = with_run_limit(facts, page_limits(facts, source, max_pages), source)
    return limited.filter(F.col("page_no").between(F.col("first_page"), F.col("last_page"))) \
        .drop("first_page", "last_page")


def empty_run_stops(facts: DataFrame, source: str = "source", run: int = EMPTY_RUN) -> DataFrame:
    """Per source the page that ends its first run of ``run`` empty pages. An empty page
    counts for each position at which a run through it may end; the last page of a run is
    the one with the highest number."""
    placed = positions(facts.select(source, "page_no", "n_records"), source)
    ends = placed.filter("n_records = 0").select(source, "page_no", F.explode(
        F.sequence(F.col("pos"), F.col("pos") + run - 1)).alias("end"))
    full = ends.groupBy(source, "end").agg(
        F.count(F.lit(1)).alias("n"), F.max("page_no").alias("page_no")).filter(F.col("n") == run)
    return full.groupBy(source).agg(F.min("page_no").alias("empty_stop"))


def stop_after_empty_run(facts: DataFrame, source: str = "source",
                         run: int = EMPTY_RUN) -> DataFrame:
    """Pages up to the end of the first run of empty pages."""
    stopped = with_run_limit(facts, empty_run_stops(facts, source, run), source)
    return stopped.filter("empty_stop is null or page_no <= empty_stop").drop("empty_stop")


def no_next_stops(facts: DataFrame, source: str = "source") -> DataFrame:
    return facts.filter(~F.col("has_next")).groupBy(source).agg(
        F.min("page_no").alias("no_next_stop"))


def stop_without_next(facts: DataFrame, source: str = "source") -> DataFrame:
    """Pages up to the first that has no next link."""
    stopped = with_run_limit(facts, no_next_stops(facts, source), source)
    return stopped.filter("no_next_stop is null or page_no <= no_next_stop").drop("no_next_stop")


def visit_limits(facts: DataFrame, source: str = "source", max_pages: int | None = MAX_PAGES,
                 run: int | None = EMPTY_RUN, without_next: bool = True) -> DataFrame:
    """First and last page that each run visits under the given stop rules. Each rule keeps
    a prefix of the run, so the tightest one decides; the limit of pages, the total shown
    and the first page without a next link come from one aggregate."""
    stops = [F.max("total_pages")]
    if max_pages is not None:
        stops.append(F.lit(max_pages))
    if without_next:
        stops.append(F.min(F.when(~F.col("has_next"), F.col("page_no"))))
    limits = facts.groupBy(source).agg(
        F.min("page_no").alias("first_page"),
        (F.least(*stops) if len(stops) > 1 else stops[0]).alias("last_page"))
    if run is None:
        return limits
    return limits.join(empty_run_stops(facts, source, run), source, "left").select(
        source, "first_page", F.least("last_page", "empty_stop").alias("last_page"))


def page_set(facts: DataFrame, source: str = "source", max_pages: int = MAX_PAGES,
             run: int = EMPTY_RUN) -> DataFrame:
    """Pages a run visits under all stop rules; the pages are joined once."""
    bounded = with_run_limit(facts, visit_limits(facts, source, max_pages, run), source)
    return bounded.filter(F.col("page_no").between(F.col("first_page"), F.col("last_page"))) \
        .drop("first_page", "last_page")


def page_totals(records: DataFrame, source: str = "source", page: str = "page_number",
                work_dir: str | None = None) -> DataFrame:
    """Records per page and running total of the run. The counts are stored first, since
    the total reads them more than once and records may be costly to extract."""
    counts = materialise(records.groupBy(source, page).agg(
        F.count(F.lit(1)).alias("n_records")), "page-counts", work_dir)
    return running_total(counts, source, page, F.col("n_records"), "running_total")
