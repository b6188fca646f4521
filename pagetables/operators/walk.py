"""Page order along next links: which page a walk starts at, and how many steps on each
page lies.

A page has one next link; where several pages lead to one, the one with the smallest
``page_id`` keeps its link, and the walks of the others end there. What is left are paths
and cycles, and these are ranked by pointer doubling: each round joins a page with the page
that its pointer leads back to and takes over that one's pointer, so that distances double.
A walk of n pages takes about log2(n) rounds of equi-joins on unique page ids, whatever the
number of walks; no walk is gathered in one task. A cycle is cut before its smallest
``page_id``, which is found on the way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.operators.sequence import next_link
from pagetables.sources.tables import materialise


def walk_links(pages: DataFrame, source: str = "source") -> DataFrame:
    """``(source, page_id, next_page_id)``: the stored page of the same run that the next link
    leads to, NULL if there is none; the first one if the address is stored more than once."""
    linked = next_link(pages).select(source, "page_id", F.coalesce(
        F.when(F.col("next_url").rlike("(?i)^https?://"), F.col("next_url")),
        F.concat(F.lit("no link "), F.col("page_id").cast("string"))).alias("_key"))
    targets = pages.groupBy(source, F.col("url").alias("_key")).agg(
        F.min("page_id").alias("next_page_id"))
    return linked.join(targets, [source, "_key"], "left").drop("_key")


def walk_order(links: DataFrame, source: str = "source", work_dir: str | None = None) -> DataFrame:
    """``(source, page_id, start_page_id, step)`` for each row of ``links``.

    ``links`` has one row ``(source, page_id, next_page_id)`` for each page, ``page_id``
    unique in all. A link to a page that is not among them, or to the page itself, is none.
    Steps count from 0 at the start of the walk. Each round is written to the shared folder before
    the next one starts, so this works when it is called.
    """
    links = materialise(links.select(source, "page_id", "next_page_id"), "walk-links", work_dir)
    before = links.filter("next_page_id <> page_id").groupBy(
        F.col("next_page_id").alias("page_id")).agg(F.min("page_id").alias("back"))
    known = materialise(links.select("page_id").join(before, "page_id", "left"), "walk-0", work_dir)
    # done: the start is known; else ``back`` lies ``span`` steps before, and ``low`` is the
    # smallest page on the way there, ``low_at`` steps before
    state = known.select(
        "page_id", "back", F.when(F.col("back").isNull(), F.col("page_id")).alias("start"),
        F.lit(0).cast("bigint").alias("step"), F.col("page_id").alias("low"),
        F.lit(0).cast("bigint").alias("low_at"))
    # A round in which nothing is done leaves cycles only; where no smallest page moved either, every
    # way looked at holds the smallest page of its cycle. What is done is not written again.
    done, open_rows = state.filter("start IS NOT NULL"), state.filter("start IS NULL")
    span, last, moves = 1, None, None
    n_open = open_rows.count()
    while n_open > 0 and not (n_open == last and moves == 0):
        there = done.unionByName(open_rows).select(
            F.col("page_id").alias("back"), F.col("back").alias("_back"), F.col("start").alias("_start"),
            F.col("step").alias("_step"), F.col("low").alias("_low"), F.col("low_at").alias("_low_at"))
        lower = F.col("_low") < F.col("low")
        moved = open_rows.join(there, "back").select(
            "page_id", F.col("_back").alias("back"), F.col("_start").alias("start"),
            F.when(F.col("_start").isNotNull(), F.col("_step") + span).otherwise(0).alias("step"),
            F.when(lower, F.col("_low")).otherwise(F.col("low")).alias("low"),
            F.when(lower, F.col("_low_at") + span).otherwise(F.col("low_at")).alias("low_at"),
            lower.alias("_moved"))
        moved = materialise(moved, "walk", work_dir)
        done = done.unionByName(moved.filter("start IS NOT NULL").drop("_moved"))
        open_rows = moved.filter("start IS NULL").drop("_moved")
        last = n_open
        n_open, moves = moved.agg(F.count_if(F.col("start").isNull()), F.count_if(F.col("start").isNull() & F.col("_moved"))).first()
        span *= 2
    # what is left lies on cycles no longer than the way looked at
    cut = done.unionByName(open_rows).select("page_id", F.coalesce("start", "low").alias("start_page_id"),
                       F.when(F.col("start").isNull(), F.col("low_at")).otherwise(
                           F.col("step")).alias("step"))
    return links.select(source, "page_id").join(cut, "page_id").select(
        source, "page_id", "start_page_id", "step")


def order_pages(pages: DataFrame, source: str = "source", work_dir: str | None = None) -> DataFrame:
    """``pages`` with ``start_page_id`` and ``step`` of their walk."""
    order = walk_order(walk_links(pages, source), source, work_dir).drop(source)
    return pages.join(order, "page_id", "left")
