"""A work queue fed by results: attempts, backoff and the moment when an item is due again.

An item's state is what its results add up to, so that their order doesn't matter: done if any of them is, else an
error at the cap of attempts, else queued until the backoff after its last failure has passed. ``queue_of`` works that
out for a table; ``queue_stream`` keeps the state of each item, by its own timers, and tells of every change.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: An item's row: ``next_at`` is null unless it is queued after a failure; ``due`` tells that this time has come.
ITEM = "url string, status string, attempts int, last_error string, next_at timestamp, due boolean"
_STATE = "attempts int, done boolean, failed_at long, failed_id long, last_error string"
#: Seconds to wait after the first failure, and at most.
FIRST_WAIT, LONGEST_WAIT = 60, 3600


def wait_seconds(attempts: Column) -> Column:
    """Doubles with each attempt, up to the longest."""
    return F.least(F.lit(LONGEST_WAIT), FIRST_WAIT * F.pow(F.lit(2), F.least(attempts, F.lit(20)) - 1)).cast("long")


def queue_of(results: DataFrame, most_attempts: int, as_of: Column) -> DataFrame:
    """The queue after all results: url, event_id, ts and error (null: done)."""
    failed = F.col("error").isNotNull()
    sums = results.groupBy("url").agg(
        F.count_if(failed).cast("int").alias("attempts"), F.bool_or(~failed).alias("done"), F.max(F.when(failed, F.struct("ts", "event_id", "error"))).alias("last"), as_of.alias("as_of")
    )
    status = F.when(F.col("done"), "done").when(F.col("attempts") >= most_attempts, "error").otherwise("queued")
    rows = sums.select("url", status.alias("status"), "attempts", F.col("last.error").alias("last_error"), F.col("last.ts").alias("failed_at"), "as_of")
    seconds = F.make_dt_interval(secs=wait_seconds(F.col("attempts")))
    rows = rows.withColumn("next_at", F.when(F.col("status") == "queued", F.col("failed_at") + seconds))
    return rows.select("url", "status", "attempts", "last_error", "next_at", F.coalesce(F.col("next_at") <= F.col("as_of"), F.lit(False)).alias("due"))


def _fold(most_attempts: int):
    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, done, failed_at, failed_id, last_error = state.get if state.exists else (0, False, None, None, None)
        if not state.hasTimedOut:
            for rows in batches:
                # plain lists: an item has few rows at a time, for which pandas' selections cost more than the work
                for at, ident, error in zip(rows["us"].tolist(), rows["event_id"].tolist(), rows["error"].tolist(), strict=True):
                    if not isinstance(error, str):
                        done = True
                        continue
                    attempts += 1
                    if failed_at is None or (at, ident) > (failed_at, failed_id):
                        failed_at, failed_id, last_error = at, ident, error
        status = "done" if done else "error" if attempts >= most_attempts else "queued"
        state.update((attempts, done, failed_at, failed_id, last_error))
        next_us = failed_at + 1_000_000 * min(LONGEST_WAIT, FIRST_WAIT * 2 ** (min(attempts, 20) - 1)) if status == "queued" else None
        now = state.getCurrentWatermarkMs() * 1000
        if next_us is not None and next_us > now:
            state.setTimeoutTimestamp(-(-next_us // 1000))
        at = pd.Series([None if next_us is None else pd.Timestamp(next_us, unit="us")], dtype="datetime64[us]")
        yield pd.DataFrame({"url": [key[0]], "status": [status], "attempts": pd.Series([attempts], dtype="int32"), "last_error": [last_error], "next_at": at, "due": [next_us is not None and next_us <= now]})

    return fold


def queue_stream(results: DataFrame, most_attempts: int, late: str = "10 minutes") -> DataFrame:
    """Each change of an item, from a stream of results; a repeated event_id counts once within the watermark.

    An item becomes due when the watermark passes its next time, by a timer of its state.
    """
    once = results.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    rows = once.select("url", "event_id", "error", "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("url").applyInPandasWithState(_fold(most_attempts), ITEM, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
