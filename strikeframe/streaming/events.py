"""Event-time windows, sessions and first sightings, alike for streams and tables, and tables kept by streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tumbling(events: DataFrame, length: str, late: str = "10 minutes", time: str = "ts", by: tuple[str, ...] = ("event_type",), slide: str | None = None) -> DataFrame:
    """Counts and sums of value by window and key; windows slide if told so."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    window = F.window(time, length, slide) if slide else F.window(time, length)
    counted = source.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes", time: str = "ts", by: str = "user_id") -> DataFrame:
    """Sessions of each key: events no further apart than the gap."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    counted = source.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return counted.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """One row of each key; a stream forgets a key when the watermark has passed it, so its state stays bounded."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def files(spark: SparkSession, path: str, schema: T.StructType, at_once: int = 1) -> DataFrame:
    """A folder's Parquet files as a stream, some files in a micro-batch, in the order of their times and names."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", at_once).parquet(path)


def each_batch(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None], mode: str = "update"):
    """Runs over what is new and stops; ``apply`` gets each micro-batch, for upserts into a table."""
    return stream.writeStream.outputMode(mode).foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_by_batch(stream: DataFrame, path: str, checkpoint: str, mode: str = "update"):
    """Writes each micro-batch to a folder of its own, overwriting it if it is run again, so that none counts twice."""
    return each_batch(stream, checkpoint, lambda rows, n: rows.write.mode("overwrite").parquet(f"{path}/batch={n}"), mode)


def latest(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The state of a table that ``kept_by_batch`` keeps: the last row of each key."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    rest = [c for c in schema.names if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*").select(*schema.names)
