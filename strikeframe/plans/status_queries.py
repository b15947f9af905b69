"""Queries of status pages and of totals that are rebuilt from rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikeframe.functions import status
from strikeframe.operators import aggregates, reshape
from strikeframe.plans import slate
from strikeframe.plans.registry import query, t
from strikeframe.plans.slate_queries import _PLAYERS, tiered_players


@query("""WITH e AS (SELECT event_id, event_id % 5 AS s, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CASE WHEN event_id % 31 = 0 OR s = 4 THEN 'attention_needed' ELSE ['healthy', 'broken', 'stale', 'odd'][s + 1] END AS state, CASE WHEN event_id % 31 > 0 AND s < 3 THEN ['System Healthy', 'System Problem', 'Refresh Recommended'][s + 1] ELSE 'Attention Needed' END AS label,
CASE WHEN event_id % 31 > 0 AND s < 2 THEN ['good', 'bad'][s + 1] ELSE 'warn' END AS tone, event_id % 31 > 0 AND event_id % 2 = 0 AS ready, CASE WHEN event_id % 31 > 0 AND event_id % 3 > 0 THEN k ELSE 0 END AS missing_odds, CAST(0 AS BIGINT) AS orphan_rows,
CASE WHEN event_id % 31 = 0 THEN '' ELSE CASE WHEN s = 0 THEN 'fine' || '|' ELSE '' END || CASE WHEN event_id % 3 > 0 THEN 'missing_odds: ' || k || '|' ELSE '' END || 'warning: w' || s || '|one|2. ' || CASE WHEN s = 1 THEN 'named' ELSE 'why' END END AS lines FROM e""")
def health_cards(spark, d):
    """Reports of health, some broken, as cards and as lines."""
    k, s = F.col("event_id"), F.col("event_id") % 5
    props = F.regexp_extract("props", r"(\d+)", 1)
    json = F.when(k % 31 == 0, F.lit('{"status": ')).otherwise(
        F.concat(
            F.lit("{"), F.when(s < 4, F.concat(F.lit('"status": "'), F.element_at(F.array(*map(F.lit, ("healthy", "broken", "stale", "odd", ""))), (s + 1).cast("int")), F.lit('", '))).otherwise(""), F.when(s == 0, '"summary": "fine", ').otherwise(""),
            F.when(k % 3 > 0, F.concat(F.lit('"counts": {"missing_odds": '), props, F.lit("}, "))).otherwise(""), F.lit('"warnings": ["w'), s, F.lit('"], "optimizer_ready": '), (k % 2 == 0).cast("string"), F.lit(', "items": ["one", {"'),
            F.when(s == 1, "name").otherwise("reason"), F.lit('": "'), F.when(s == 1, "named").otherwise("why"), F.lit('"}]}'),
        )
    )
    card = status.health_card(json)
    rows = t(spark, d, "events").select("event_id", card.alias("c"), F.array_join(status.detail_lines(json), "|").alias("lines"))
    return rows.select("event_id", "c.state", "c.label", "c.tone", "c.ready", "c.counts.missing_odds", "c.counts.orphan_rows", "lines")


@query(
    _PLAYERS
    + """, s AS (SELECT slate_id, count(*) AS players, count(DISTINCT fight_id) AS fights, quantile_cont(m / 8, 0.75) AS value75, quantile_cont(m * 2, 0.9) AS ceiling90, quantile_cont(own_proj, 0.9) AS own90, arg_min(player_id, ROW(-m, player_id)) AS top_mean, arg_min(player_id, ROW(-coalesce(leverage, 0), player_id)) AS top_leverage FROM r GROUP BY slate_id)
SELECT * FROM s"""
)
def slate_summaries(spark, d):
    """A summary of every slate: its counts, percentiles and the first of some boards."""
    return slate.summaries(slate.owned(tiered_players(spark, d), "slate_id"), "slate_id").select("slate_id", "players", "fights", "value75", "ceiling90", "own90", "top_mean", "top_leverage")


@query("""WITH r AS (SELECT l_orderkey, CASE WHEN l_linenumber % 3 > 0 THEN CAST(l_quantity AS BIGINT) END AS a, CASE WHEN l_linenumber % 4 > 0 THEN CAST(l_quantity AS BIGINT) + 5 END AS b, CASE WHEN l_orderkey % 2 = 0 THEN l_suppkey % 200 - 20 END AS c FROM lineitem),
s AS (SELECT l_orderkey, CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b, CAST(sum(c) AS BIGINT) AS c FROM r GROUP BY l_orderkey)
SELECT l_orderkey, CAST(a AS VARCHAR) || ' of ' || CAST(b AS VARCHAR) AS sig_text, CASE WHEN b > 0 THEN 100.0::DOUBLE * a / b END AS sig_pct, CASE WHEN c IS NOT NULL THEN greatest(c, 0) // 60 || ':' || lpad(CAST(greatest(c, 0) % 60 AS VARCHAR), 2, '0') END AS ctrl FROM s""")
def rebuilt_totals(spark, d):
    """Totals that are missing, rebuilt from rounds: sums that are null only if all are, as pairs, percentages and m:ss."""
    q, n = F.col("l_quantity").cast("long"), F.col("l_linenumber")
    rows = t(spark, d, "lineitem").select("l_orderkey", F.when(n % 3 > 0, q).alias("a"), F.when(n % 4 > 0, q + 5).alias("b"), F.when(F.col("l_orderkey") % 2 == 0, F.col("l_suppkey") % 200 - 20).alias("c"))
    out = rows.groupBy("l_orderkey").agg(*aggregates.pair_totals("a", "b", "sig"), F.sum("c").alias("c"))
    return out.select("l_orderkey", "sig_text", "sig_pct", status.clock_of_sum(F.col("c")).alias("ctrl"))


@query("""WITH r AS (SELECT l_returnflag, CASE WHEN l_linenumber > 2 THEN CAST(l_quantity AS BIGINT) END AS landed, l_suppkey % 7 AS downs FROM lineitem)
SELECT l_returnflag, 'landed' AS stat_key, CAST(sum(coalesce(landed, 0)) AS BIGINT) AS total FROM r GROUP BY 1 UNION ALL SELECT l_returnflag, 'downs', CAST(sum(coalesce(downs, 0)) AS BIGINT) FROM r GROUP BY 1""")
def filled_totals(spark, d):
    """Sums of statistics as rows, missing values as 0."""
    rows = t(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_linenumber") > 2, F.col("l_quantity").cast("long")).alias("landed"), (F.col("l_suppkey") % 7).alias("downs"))
    long = reshape.long_statistics(rows, ["l_returnflag"], ["landed", "downs"])
    return long.groupBy("l_returnflag", "stat_key").agg(F.sum(F.coalesce("value", F.lit(0))).alias("total"))


@query("""SELECT o_orderpriority, o_orderstatus, side, CAST(sum(v) AS BIGINT) AS total FROM (SELECT o_orderpriority, o_orderstatus, unnest(['A', 'B']) AS side, unnest([o_orderkey % 10, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey % 10 END]) AS v FROM orders) GROUP BY ALL""")
def entries_of_sides(spark, d):
    """Statistics kept as a map, a row for each and for each side."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    maps = t(spark, d, "orders").select("o_orderpriority", F.create_map("o_orderstatus", F.struct((k % 10).alias("a"), F.when(k % 3 > 0, c % 10).alias("b"))).alias("stats"))
    rows = reshape.entries(maps, "stats", ["o_orderpriority"])
    sides = reshape.mirrored(rows, ["o_orderpriority", "stat_key"], {"side": F.lit("A"), "v": F.col("value.a")}, {"side": F.lit("B"), "v": F.col("value.b")})
    return sides.groupBy("o_orderpriority", F.col("stat_key").alias("o_orderstatus"), "side").agg(F.sum("v").alias("total"))


@query("""SELECT flag, value FROM (SELECT 'flag ' || r_regionkey AS flag, CASE WHEN r_regionkey % 2 = 0 THEN r_name END AS value FROM region)""")
def system_flags(spark, d):
    """A table of flags read as one map, and its entries."""
    k = F.col("r_regionkey")
    flags = t(spark, d, "region").select(F.concat(F.lit("flag "), k).alias("key"), F.when(k % 2 == 0, F.col("r_name")).alias("value_text"))
    return status.flag_map(flags).select(F.explode("flags").alias("flag", "value"))
