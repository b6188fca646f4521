"""Event-time windows over rows that arrive out of order; late rows are kept, not dropped.

A batch folds its rows into partial results, one row for each window, key and batch, and writes these
as a folder of a log, so that a batch done again after a failure changes nothing. The watermark of a batch is
the greatest time of the batches *before* it, less the lateness: it follows from the log alone, so a
replay or a restart judges rows alike. Rows of windows that the watermark has passed go, counted by
window and key, to a table of their own, and no finished window ever changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from pagetables.streaming.log import BatchLog

TOTAL = "decimal(38,6)"
#: Sessions are first put together within pieces of time of this many gaps, so that a key may have many tasks.
PIECE = 1000


def _micros(spark: SparkSession, interval: str) -> int:
    return spark.sql(f"SELECT unix_micros(timestamp'1970-01-01 00:00:00 UTC' + INTERVAL {interval}) AS w").first()["w"]


def _totals() -> list[Column]:
    return [F.sum("n").alias("n"), F.sum("total").cast(TOTAL).alias("total"),
            F.min("least").alias("least"), F.max("greatest").alias("greatest")]


def merge_sessions(parts: DataFrame, keys: list[str], piece: int) -> DataFrame:
    """Put sessions (``start``, ``end`` and totals) that overlap or touch together, for each key.

    First within pieces of ``piece`` microseconds by start, so that the rows of one key are dealt to many tasks, then
    over the borders of the pieces, where a piece has one row for each session left.
    """
    length = F.unix_micros("end") - F.unix_micros("start")
    session = F.session_window("start", F.concat(length.cast("string"), F.lit(" microseconds"))).alias("_s")
    inner = parts.withColumn("_piece", F.floor(F.unix_micros("start") / piece)).groupBy(
        *keys, "_piece", session).agg(*_totals()).select(*keys, "_s.start", "_s.end", "n", "total", "least", "greatest")
    return inner.groupBy(*keys, session).agg(*_totals()).select(
        *keys, "_s.start", "_s.end", "n", "total", "least", "greatest")


class EventWindows:
    """Windows of a stream of rows, kept in ``folder``: how many rows, and total, least and greatest ``value``.

    ``width`` alone gives tumbling windows, with ``slide`` sliding ones; ``gap`` instead gives sessions, which
    end that long after their last row. All are intervals such as '1 hour'. ``keys`` are names with types, such as
    'user_id bigint'; rows with a NULL key are a key of their own. Rows whose ``time`` is NULL are in no window and
    are counted as late ones without a window. Windows hold their start but not their end; NULL values count as
    rows only, others are rounded to six decimals.
    """

    def __init__(self, spark: SparkSession, folder: str, time: str, value: str, keys: list[str] = (),
                 width: str | None = None, slide: str | None = None, gap: str | None = None, lateness: str = "1 day"):
        if (width is None) == (gap is None) or (slide and gap):
            raise ValueError("give a width, with or without a slide, or a gap")
        self.time, self.value, self.width, self.slide, self.gap = time, value, width, slide, gap
        self.keys = [k.split()[0] for k in keys]
        self.lateness = _micros(spark, lateness)
        self.piece = PIECE * _micros(spark, gap) if gap else 0
        window = "start timestamp, end timestamp"
        named = "".join(f"{k}, " for k in keys)
        self.parts = BatchLog(spark, f"{folder}/parts", f"{named}{window}, n bigint, total {TOTAL}, "
                                                        f"least {TOTAL}, greatest {TOTAL}")
        self.dropped = BatchLog(spark, f"{folder}/late", f"{named}{window}, n bigint")
        self.marks = BatchLog(spark, f"{folder}/marks", "seen timestamp")

    def watermark(self, before: int | None = None) -> DataFrame:
        """One row, ``mark``: windows that end by then are finished. NULL while nothing has arrived."""
        seen = F.unix_micros(F.max("seen"))
        return self.marks.read(before).agg(F.timestamp_micros(seen - self.lateness).alias("mark"))

    def _windowed(self, rows: DataFrame) -> DataFrame:
        value = F.col(f"`{self.value}`").cast(TOTAL)
        at = F.col(f"`{self.time}`").cast("timestamp")
        rows = rows.select(*(F.col(f"`{k}`") for k in self.keys), at.alias("_at"), value.alias("_value"))
        if self.gap:
            return rows.select(*self.keys, "_value", F.col("_at").alias("start"),
                               (F.col("_at") + F.expr(f"INTERVAL {self.gap}")).alias("end"))
        window = F.window("_at", self.width, self.slide or self.width).alias("_w")
        timed = rows.filter("_at IS NOT NULL").select(*self.keys, "_value", window).select(
            *self.keys, "_value", "_w.start", "_w.end")
        return timed.unionByName(rows.filter("_at IS NULL").select(*self.keys, "_value"), allowMissingColumns=True)

    def add(self, rows: DataFrame, batch: int) -> None:
        """Take up the rows of a batch. Doing this again for the same batch changes nothing."""
        mark = self.watermark(before=batch).first()["mark"]  # one value
        late = F.col("end").isNull()
        if mark is not None:
            late = late | (F.col("end") <= F.lit(mark))
        windowed = self._windowed(rows)
        self.dropped.write(windowed.filter(late).groupBy(*self.keys, "start", "end").agg(
            F.count(F.lit(1)).alias("n")), batch)
        folded = windowed.filter(~late).groupBy(*self.keys, "start", "end").agg(
            F.count(F.lit(1)).alias("n"), F.sum("_value").cast(TOTAL).alias("total"),
            F.min("_value").alias("least"), F.max("_value").alias("greatest"))
        self.parts.write(merge_sessions(folded, self.keys, self.piece) if self.gap else folded, batch)
        # written last: a batch that failed before has not moved the mark
        at = F.col(f"`{self.time}`").cast("timestamp")
        self.marks.write(rows.agg(F.max(at).alias("seen")).filter("seen IS NOT NULL"), batch)

    def current(self) -> DataFrame:
        """All windows so far: keys, ``start, end, n, total, least, greatest``, and whether they are ``finished``."""
        parts = self.parts.read().drop("batch")
        if self.gap:
            merged = merge_sessions(parts, self.keys, self.piece)
        else:
            merged = parts.groupBy(*self.keys, "start", "end").agg(*_totals())
        # one row, so that the join is with one value
        return merged.join(F.broadcast(self.watermark())).withColumn(
            "finished", F.coalesce(F.col("end") <= F.col("mark"), F.lit(False))).drop("mark")

    def finished(self) -> DataFrame:
        """Windows that can no longer change."""
        return self.current().filter("finished").drop("finished")

    def late(self) -> DataFrame:
        """Rows that came after their window was finished: keys, ``start, end, n``."""
        return self.dropped.read().groupBy(*self.keys, "start", "end").agg(F.sum("n").alias("n"))


def window_arrivals(rows: DataFrame, windows: EventWindows, checkpoint: str) -> StreamingQuery:
    """Fold a stream of rows into the windows; works off what has arrived and ends. A restart goes on after
    the last finished batch."""
    return (rows.writeStream.foreachBatch(windows.add).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
