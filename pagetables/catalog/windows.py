"""Event-time windows over events that arrive out of order, some of them too late."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetables.catalog.base import query, work_dir
from pagetables.sources import tables
from pagetables.streaming.windows import EventWindows, window_arrivals

#: Events come in three deliveries by time; every fiftieth comes one later, one in 211 only with the last.
DELIVERIES = ("2024-01-11 00:00:00", "2024-01-21 00:00:00")

ARRIVED = """
WITH event AS (SELECT event_id, ts, event_type, user_id, CAST(value AS DECIMAL(38,6)) AS v, least(2,
    CASE WHEN event_id % 211 = 5 THEN 2 ELSE
    CASE WHEN ts < TIMESTAMP '{}' THEN 0 WHEN ts < TIMESTAMP '{}' THEN 1 ELSE 2 END
    + CASE WHEN event_id % 50 = 7 THEN 1 ELSE 0 END END) AS batch FROM events),
seen AS (SELECT batch, max(ts) AS m FROM event GROUP BY batch),
marked AS (SELECT e.*, (SELECT max(m) FROM seen s WHERE s.batch < e.batch) - INTERVAL 1 DAY AS mark FROM event e),
top AS (SELECT max(m) - INTERVAL 1 DAY AS mark FROM seen),
""".format(*DELIVERIES)

GRID = ARRIVED + """
step AS (SELECT unnest(range({steps})) AS i),
placed AS (SELECT m.*, time_bucket(INTERVAL '{slide}', ts, TIMESTAMP '1970-01-01') - i * INTERVAL '{slide}' AS w_start
           FROM marked m, step),
timed AS (SELECT *, w_start + INTERVAL '{width}' AS w_end FROM placed WHERE w_start + INTERVAL '{width}' > ts),
judged AS (SELECT *, coalesce(w_end <= mark, FALSE) AS is_late FROM timed)
SELECT event_type, w_start, w_end, count(*) FILTER (NOT is_late) AS n_rows, count(*) FILTER (is_late) AS n_late,
       CAST(sum(v) FILTER (NOT is_late) AS DECIMAL(38,6)) AS total, min(v) FILTER (NOT is_late) AS least_value,
       max(v) FILTER (NOT is_late) AS greatest_value
FROM judged WHERE w_end <= (SELECT mark FROM top) GROUP BY event_type, w_start, w_end"""


def delivered(spark, sf_dir, windows, name):
    """Run the stream over the deliveries, one after another."""
    folder = tables.scratch_path(spark, name, work_dir(spark))
    at = F.col("ts").cast("timestamp")
    batch = F.when(F.col("event_id") % 211 == 5, 2).otherwise(F.least(F.lit(2), F.when(
        at < F.lit(DELIVERIES[0]).cast("timestamp"), 0).when(at < F.lit(DELIVERIES[1]).cast("timestamp"), 1).otherwise(2)
        + F.when(F.col("event_id") % 50 == 7, 1).otherwise(0)))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_type", "user_id", at.alias("ts"), "value", batch.alias("_batch"))
    for n in range(len(DELIVERIES) + 1):
        events.filter(F.col("_batch") == n).drop("_batch").write.mode("append").parquet(folder)
        arriving = spark.readStream.schema(events.drop("_batch").schema).parquet(folder)
        window_arrivals(arriving, windows, f"{folder}-log").awaitTermination()
    return windows


def _state(spark, **more):
    return EventWindows(spark, tables.scratch_path(spark, "windows", work_dir(spark)), "ts", "value", **more)


def _with_late(windows, keys):
    mark = windows.watermark()
    late = windows.late().withColumnRenamed("n", "n_late").join(F.broadcast(mark)).filter(
        F.col("end") <= F.col("mark")).drop("mark")
    both = windows.finished().join(late, [*keys, "start", "end"], "full")
    return both.select(*keys, F.col("start").alias("w_start"), F.col("end").alias("w_end"),
                       F.coalesce("n", F.lit(0)).alias("n_rows"), F.coalesce("n_late", F.lit(0)).alias("n_late"),
                       "total", F.col("least").alias("least_value"), F.col("greatest").alias("greatest_value"))


@query("window_tumbling_late", GRID.format(steps=1, slide="6 hours", width="6 hours"))
def tumbling(spark, sf_dir):
    windows = _state(spark, keys=["event_type string"], width="6 hours")
    return _with_late(delivered(spark, sf_dir, windows, "tumbling"), ["event_type"])


@query("window_sliding_late", GRID.format(steps=3, slide="4 hours", width="12 hours"))
def sliding(spark, sf_dir):
    windows = _state(spark, keys=["event_type string"], width="12 hours", slide="4 hours")
    return _with_late(delivered(spark, sf_dir, windows, "sliding"), ["event_type"])


@query("window_sessions", ARRIVED + """
kept AS (SELECT * FROM marked WHERE mark IS NULL OR ts + INTERVAL 2 HOUR > mark),
opened AS (SELECT *, CASE WHEN ts - INTERVAL 2 HOUR > lag(ts) OVER w THEN 1 ELSE 0 END AS opens FROM kept
           WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM opened),
grouped AS (SELECT user_id, min(ts) AS s_start, max(ts) + INTERVAL 2 HOUR AS s_end, count(*) AS n_rows,
                   CAST(sum(v) AS DECIMAL(38,6)) AS total FROM numbered GROUP BY user_id, session)
SELECT * FROM grouped WHERE s_end <= (SELECT mark FROM top)""")
def sessions(spark, sf_dir):
    windows = _state(spark, keys=["user_id bigint"], gap="2 hours")
    return delivered(spark, sf_dir, windows, "sessions").finished().select(
        "user_id", F.col("start").alias("s_start"), F.col("end").alias("s_end"), F.col("n").alias("n_rows"), "total")


@query("window_late_rows", ARRIVED + """
late AS (SELECT user_id, ts AS late_at FROM marked WHERE ts + INTERVAL 2 HOUR <= mark)
SELECT user_id, late_at, count(*) AS n_late FROM late GROUP BY user_id, late_at""")
def late_rows(spark, sf_dir):
    windows = _state(spark, keys=["user_id bigint"], gap="2 hours")
    return delivered(spark, sf_dir, windows, "late").late().select(
        "user_id", F.col("start").alias("late_at"), F.col("n").alias("n_late"))
