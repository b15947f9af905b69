"""Queries of JSON payloads: their keys and types, and the matrices that models are fitted to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeframe.functions import payloads
from strikeframe.plans.registry import query, t


def feature_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Events with payloads of some differences, as numbers or texts, some of them missing; some payloads are no objects, or broken."""
    k, props = F.col("event_id"), F.col("props")
    won = F.when(k % 3 == 0, F.lit("1")).when(k % 3 == 1, F.lit("0")).otherwise(F.lit("null"))
    inner = F.concat(
        F.regexp_replace(props, r"\}$", ""), F.lit(', "diff_value": '), F.col("value").cast("string"), F.lit(', "diff_age": "'), (k % 40).cast("string"), F.lit('"'),
        F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(', "diff_reach": '), (k % 9 - 4).cast("string"))), F.lit(', "win": '), won, F.lit(', "finish": "'), F.when(k % 2 == 0, "yes").otherwise("no"), F.lit('"}'),
    )
    json = F.when(k % 17 == 0, F.concat(F.lit("["), props, F.lit("]"))).when(k % 19 == 0, F.lit('{"diff_broken": ')).when(k % 23 == 0, F.lit("null")).otherwise(inner)
    return t(spark, d, "events").select("event_id", "event_type", payloads.variant(json).alias("payload"))


_ROWS = """WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value, event_id % 40 AS age, CASE WHEN event_id % 5 > 0 THEN event_id % 9 - 4 END AS reach,
CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS win, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS finish FROM events WHERE event_id % 17 > 0 AND event_id % 19 > 0 AND event_id % 23 > 0)
"""


@query(
    _ROWS
    + """SELECT key, count(*) AS n FROM (SELECT unnest(CASE WHEN reach IS NULL THEN ['k', 'diff_value', 'diff_age', 'win', 'finish'] ELSE ['k', 'diff_value', 'diff_age', 'diff_reach', 'win', 'finish'] END) AS key FROM e) GROUP BY key"""
)
def payload_keys(spark, d):
    """The keys of all payloads and how many have them; what is no object has none."""
    return payloads.keys_of(feature_payloads(spark, d), "payload").select("key", "n")


@query(_ROWS + "SELECT event_id, CAST(age AS DOUBLE) AS x1, CAST(reach AS DOUBLE) AS x2, value AS x3, CAST(win AS DOUBLE) AS y FROM e WHERE win IS NOT NULL AND reach IS NOT NULL")
def win_matrix(spark, d):
    """The matrix of the win model: every key that begins with diff_, and whether the side won."""
    rows = feature_payloads(spark, d)
    keys = payloads.feature_keys(rows, "payload", "diff_")
    out = payloads.matrix(rows, "payload", keys, payloads.figure(F.col("payload"), "win"), ["event_id"])
    return out.select("event_id", *[F.get("x", F.lit(i)).alias(f"x{i + 1}") for i in range(3)], "y")


@query(_ROWS + "SELECT event_id, CAST(age AS DOUBLE) AS x1, CAST(reach AS DOUBLE) AS x2, value AS x3, CAST(finish AS DOUBLE) AS y FROM e WHERE win = 1 AND reach IS NOT NULL")
def finish_matrix(spark, d):
    """The matrix of the finish model: the winners' payloads, and whether the fight ended early."""
    rows = feature_payloads(spark, d)
    keys = payloads.feature_keys(rows, "payload", "diff_")
    early = F.when(F.try_variant_get("payload", "$.finish", "string") == "yes", 1).otherwise(0)
    winners = rows.where(payloads.figure(F.col("payload"), "win") == 1)
    return payloads.matrix(winners, "payload", keys, early, ["event_id"]).select("event_id", *[F.get("x", F.lit(i)).alias(f"x{i + 1}") for i in range(3)], "y")
