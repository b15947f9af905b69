"""Queries that play the events table as a stream of files and return the table that the stream keeps.

Each equals the query of the same figures over the whole table: what a stream adds is the state that it keeps between
its micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeframe.plans.registry import query, t
from strikeframe.sources.scratch import discard, shared_folder, written
from strikeframe.streaming import events as streams
from strikeframe.streaming import queue

#: Files that the events are played from, and how many make a micro-batch.
FILES, AT_ONCE = 4, 2


def as_files(events: DataFrame, path: str, time: str = "ts") -> int:
    """The events as files in the order of their time, every tenth a file too late; the seconds that rows may lie behind."""
    first, last = events.agg(F.min(F.unix_micros(time)), F.max(F.unix_micros(time))).first()
    first, last = first or 0, last or 0
    width = (last - first) // FILES + 1
    own = F.coalesce(F.floor((F.unix_micros(time) - first) / width), F.lit(0))
    place = F.least(own + (F.pmod(F.xxhash64("event_id"), F.lit(10)) == 0).cast("int"), F.lit(FILES - 1))
    rows = written(events.withColumn("__file__", place), "events")
    for n in range(FILES):
        rows.where(F.col("__file__") == n).drop("__file__").coalesce(1).write.mode("append").parquet(path)
    return 3 * width // 1_000_000 + 1


def played(spark: SparkSession, events: DataFrame, plan: Callable[[DataFrame, str], DataFrame], keys: list[str], mode: str = "update") -> DataFrame:
    """What the stream of ``plan`` keeps of the events, by key."""
    source, kept, checkpoint = (shared_folder(spark, label) for label in ("stream-source", "stream-kept", "stream-checkpoint"))
    late = as_files(events, source)
    stream = plan(streams.files(spark, source, events.schema, AT_ONCE), f"{late} seconds")
    streams.kept_by_batch(stream, kept, checkpoint, mode).awaitTermination()
    discard(spark, [source, checkpoint])
    return streams.latest(spark, kept, stream.schema, keys)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streamed_windows(spark, d):
    """Hourly counts kept by a stream, rows that come late included."""
    out = played(spark, _events(spark, d), lambda s, late: streams.tumbling(s, "1 hour", late), ["window_start", "event_type"])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def streamed_sessions(spark, d):
    """Sessions that a stream tells once they are over; a last event, of no user, ends them all."""
    rows = _events(spark, d)
    end = rows.agg(F.max("ts").alias("ts"), F.min("ts").alias("first")).select(
        F.lit(-1).cast("long").alias("event_id"), F.timestamp_micros(4 * F.unix_micros("ts") - 3 * F.unix_micros("first") + 86_400_000_000).alias("ts"), F.lit(None).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value")
    )
    source, kept, checkpoint = (shared_folder(spark, label) for label in ("stream-source", "stream-kept", "stream-checkpoint"))
    late = as_files(rows, source)
    end.coalesce(1).write.mode("append").parquet(source)
    stream = streams.sessions(streams.files(spark, source, rows.schema, AT_ONCE), "1 hour", f"{late} seconds")
    streams.kept_by_batch(stream, kept, checkpoint, "append").awaitTermination()
    discard(spark, [source, checkpoint])
    out = streams.latest(spark, kept, stream.schema, ["user_id", "session_start"]).where("user_id is not null")
    return out.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")], "n")


@query("""WITH r AS (SELECT 'u' || user_id || '/' || event_id % 3 AS url, event_id, ts, CASE WHEN event_type = 'error' THEN 'code ' || event_id % 5 END AS error FROM events WHERE event_type = 'error' OR value > 99),
s AS (SELECT url, count(error) AS attempts, count(*) > count(error) AS done, max(CASE WHEN error IS NOT NULL THEN ROW(ts, event_id, error) END) AS l FROM r GROUP BY url)
SELECT url, CASE WHEN done THEN 'done' WHEN attempts >= 4 THEN 'error' ELSE 'queued' END AS status, CAST(attempts AS INTEGER) AS attempts, l[3] AS last_error,
CASE WHEN NOT done AND attempts < 4 THEN l[1] + to_seconds(60 * 2 ** (attempts - 1)) END AS next_at FROM s""")
def streamed_queue(spark, d):
    """A crawl queue kept by a stream of results: repeats dropped, attempts counted, the next one's time by backoff."""
    failed = F.col("event_type") == "error"
    rows = _events(spark, d).where(failed | (F.col("value") > 99)).select(
        "event_id", "ts", F.concat(F.lit("u"), F.col("user_id"), F.lit("/"), F.col("event_id") % 3).alias("url"), F.when(failed, F.concat(F.lit("code "), F.col("event_id") % 5)).alias("error")
    )
    twice = rows.unionByName(rows.where(F.col("event_id") % 7 == 0))
    out = played(spark, twice, lambda s, late: queue.queue_stream(s, 4, late), ["url"], "append")
    return out.select("url", "status", "attempts", "last_error", F.col("next_at").cast("timestamp_ntz").alias("next_at"))
