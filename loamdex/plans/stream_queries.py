"""Streaming jobs over events, run until all available rows are processed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.plans.registry import Tables, query
from loamdex.streaming import jobs


def events(t: Tables) -> DataFrame:
    return jobs.source(t.spark, f"{t.folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("U6", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def stream_dedup(t: Tables) -> DataFrame:
    rows = jobs.run_available(jobs.without_repeats(events(t), ["event_id"], "ts", "60 days"), jobs.folder(t.spark))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "W4",
    """WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 3 DAY THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS began, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, session""",
)
def stream_sessions(t: Tables) -> DataFrame:
    place = jobs.folder(t.spark)
    rows = jobs.run_available(jobs.sessions(events(t), "user_id", "ts", "3 days"), place, "complete", jobs.latest_batch(place))
    return rows.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("began"), "n", F.round("total", 4).alias("total"))


@query("T3", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def stream_incremental_merge(t: Tables) -> DataFrame:
    place, stream = jobs.folder(t.spark), events(t).select("user_id", "event_id")
    jobs.run_merged(stream, place, ["user_id"], "event_id")
    return jobs.run_merged(stream, place, ["user_id"], "event_id")  # nothing is new: the table stays


@query("T12", "SELECT count(*) AS n, round(sum(value), 4) AS total FROM events")
def stream_small_batches(t: Tables) -> DataFrame:
    """A file a batch, so a batch's size is bounded however much is waiting."""
    stream = jobs.source(t.spark, f"{t.folder}/events.parquet", files_per_batch=1).select("event_id", "value")
    return jobs.run_available(stream, jobs.folder(t.spark)).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
