"""Stop rules of listing runs while pages arrive.

Pages of a run arrive in any order, over any number of batches. A batch adds the facts of its
pages (a few numbers each) to a log, works out the limits of the runs that it touches from
all their facts so far, and adds these to a second log; the newest limits of a run count. So after
each batch the visited pages are those that the batch rules give for all that has
arrived. A run is settled when no page that may still come can change its limits: its facts
are not kept or looked at any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from pagetables.functions.fixed import EMPTY_RUN, MAX_PAGES
from pagetables.operators.sequence import visit_limits
from pagetables.plans.listing import page_facts
from pagetables.streaming.log import BatchLog

FACTS = "page_id bigint, page_no int, total_pages int, has_next boolean, n_records int, source string"
LIMITS = "source string, first_page int, last_page int, n_pages bigint, settled boolean"


class StopRules:
    """Facts and limits of runs, kept in ``folder``.

    ``max_pages``, ``empty_run`` and ``without_next`` are the rules of ``visit_limits``; pages
    need a ``page_no`` of their own, those without one are not counted. A page that is
    stored again is one more page of its number, as in the batch rules.
    """

    def __init__(self, spark: SparkSession, folder: str, max_pages: int = MAX_PAGES,
                 empty_run: int | None = EMPTY_RUN, without_next: bool = True):
        self.max_pages, self.empty_run, self.without_next = max_pages, empty_run, without_next
        self.facts = BatchLog(spark, f"{folder}/facts", FACTS)
        self.limits = BatchLog(spark, f"{folder}/limits", LIMITS)

    def add(self, facts: DataFrame, batch: int) -> None:
        """Take up the facts of a batch. Doing this again for the same batch changes nothing."""
        settled = self.current(before=batch).filter("settled").select("source")
        new = facts.filter(F.col("page_no").isNotNull()).join(settled, "source", "left_anti")
        self.facts.write(new, batch)
        known = self.facts.read(before=batch + 1)
        touched = known.filter(F.col("batch") == batch).select("source").distinct()
        known = known.join(touched, "source", "left_semi")
        limits = visit_limits(known, "source", self.max_pages, self.empty_run, self.without_next)
        shown = known.groupBy("source").agg(F.max("total_pages").alias("total"))
        inside = known.join(limits, "source").filter("page_no <= last_page").groupBy("source").agg(
            F.count(F.lit(1)).alias("n_pages"), F.countDistinct("page_no").alias("_different"))
        # every number from 1 on is there, and the total shown, which can only grow, is beyond the stop
        settled = ((F.col("first_page") == 1) & (F.col("_different") == F.col("last_page"))
                   & (F.col("total") > F.col("last_page")))
        self.limits.write(limits.join(inside, "source").join(shown, "source").withColumn(
            "settled", F.coalesce(settled, F.lit(False))), batch)

    def current(self, before: int | None = None) -> DataFrame:
        """``(source, first_page, last_page, n_pages, settled)``: the newest limits of each run."""
        row = F.struct("first_page", "last_page", "n_pages", "settled")
        return self.limits.read(before).groupBy("source").agg(
            F.max_by(row, "batch").alias("l")).select("source", "l.*")

    def visited(self, rows: DataFrame) -> DataFrame:
        """Rows (``source``, ``page_no``) of pages within the limits of their run so far."""
        limits = self.current().select("source", "first_page", "last_page")
        return rows.join(limits, "source").filter(
            F.col("page_no").between(F.col("first_page"), F.col("last_page"))).drop("first_page", "last_page")

    def wanted(self) -> DataFrame:
        """Runs that may still bring pages."""
        return self.current().filter("NOT settled")


def follow_arrivals(pages: DataFrame, rules: StopRules, checkpoint: str,
                    whole_word: bool = False) -> StreamingQuery:
    """Apply the rules to a stream of pages (``source, page_id, url, html``); works off what has
    arrived and ends. A restart goes on after the last finished batch."""
    facts = page_facts(pages, whole_word=whole_word).select(
        *(f.split()[0] for f in FACTS.split(", ")))
    return (facts.writeStream.foreachBatch(rules.add).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
