"""Streams from files: restarts, late rows, repeats, and the queue's timers."""

import datetime as dt

from pyspark.sql import functions as F

from strikeframe.streaming import events as streams
from strikeframe.streaming import queue

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def event(i, minute, user=1, kind="a"):
    return i, START + dt.timedelta(minutes=minute), user, kind, 1.0


def test_a_restart_repeats_nothing(spark, tmp_path):
    source, kept, mark = (str(tmp_path / n) for n in ("source", "kept", "mark"))
    batches = [[event(1, 0), event(2, 50)], [event(3, 70), event(4, 10)], [event(5, 130), event(6, 20, kind="b")]]
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    put(batches[0])
    stream = streams.tumbling(streams.files(spark, source, spark.createDataFrame([], SCHEMA).schema), "1 hour", "1 day")
    for rows in (*batches[1:], None, None):  # the last run finds nothing new
        streams.kept_by_batch(stream, kept, mark).awaitTermination()
        if rows:
            put(rows)
    got = streams.latest(spark, kept, stream.schema, ["window_start", "event_type"])
    every = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, streams.tumbling(every, "1 hour").collect()))
    assert spark.read.parquet(kept).where("batch = 0").count() == 1  # a batch's own changes stay apart


def test_first_seen(spark, tmp_path):
    source = str(tmp_path / "source")
    rows = [event(1, 0), event(1, 1), event(2, 5)]
    frame = spark.createDataFrame(rows, SCHEMA)
    frame.coalesce(1).write.parquet(source)
    spark.createDataFrame([event(1, 2), event(3, 6)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = streams.first_seen(streams.files(spark, source, frame.schema), ["event_id"])
    streams.kept_by_batch(stream, str(tmp_path / "kept"), str(tmp_path / "mark"), "append").awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "kept")).collect()) == [1, 2, 3]
    assert streams.first_seen(frame, ["event_id"]).count() == 2


def result(url, i, minute, error):
    return url, i, START + dt.timedelta(minutes=minute), error


def test_queue(spark, tmp_path):
    schema = "url string, event_id long, ts timestamp, error string"
    rows = [result("a", 1, 0, "x"), result("a", 2, 3, None), result("b", 3, 1, "x"), result("b", 4, 0, "y"), result("c", 5, 0, "1"), result("c", 6, 1, "2"), result("c", 7, 2, "3"), result("d", 8, 100, "z")]
    source, kept = str(tmp_path / "source"), str(tmp_path / "kept")
    for part in (rows[:3], rows[:2] + rows[3:6], rows[6:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = queue.queue_stream(streams.files(spark, source, spark.createDataFrame([], schema).schema), 3, "30 minutes")
    streams.kept_by_batch(stream, kept, str(tmp_path / "mark"), "append").awaitTermination()
    got = sorted(map(tuple, streams.latest(spark, kept, stream.schema, ["url"]).collect()))
    as_of = F.lit(START + dt.timedelta(minutes=70))  # the newest time less the watermark's delay
    assert got == sorted(map(tuple, queue.queue_of(spark.createDataFrame(rows, schema), 3, as_of).collect()))
    minute = lambda n: START + dt.timedelta(minutes=n)
    assert got == [("a", "done", 1, "x", None, False), ("b", "queued", 2, "x", minute(3), True), ("c", "error", 3, "3", None, False), ("d", "queued", 1, "z", minute(101), False)]
