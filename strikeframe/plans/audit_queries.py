"""Queries of audits, repairs and merges; lines of orders serve as the statistics of fights and rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strikeframe.operators import audit
from strikeframe.plans import marts
from strikeframe.plans.registry import query, t
from strikeframe.sources import sinks
from strikeframe.sources.scratch import shared_folder


def _stats(spark: SparkSession, d: str) -> DataFrame:
    """Lines as statistics: some negative, some with more landed than attempted, some beyond the bounds."""
    q, p, s, n = F.col("l_quantity").cast("int"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    return t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", q.alias("sig_landed"), (q + p % 23 - 1).alias("sig_att"), (q + 10).alias("total_landed"), F.when(n > 1, q * (p % 16)).alias("total_att"),
        (s % 4).alias("td_landed"), (s % 53).alias("td_att"), (p % 60 - 1).alias("kd"), (s % 3).alias("sub_att"), F.lit(None).cast("int").alias("rev"), (p * n % 3700).alias("ctrl_sec"),
    )


_STATS = """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q, CAST(l_quantity AS BIGINT) + l_partkey % 23 - 1 AS sig_att, CASE WHEN l_linenumber > 1 THEN CAST(l_quantity AS BIGINT) * (l_partkey % 16) END AS total_att,
l_suppkey % 4 AS td_landed, l_suppkey % 53 AS td_att, l_partkey % 60 - 1 AS kd, l_partkey * l_linenumber % 3700 AS ctrl_sec FROM lineitem)
"""
_FIGHT = "(kd < 0 OR q > sig_att OR coalesce(q + 10 > total_att, false) OR td_landed > td_att OR ctrl_sec > 3600 OR sig_att > 500 OR coalesce(total_att > 700, false) OR td_att > 50)"
_ROUND = "(kd < 0 OR q > sig_att OR coalesce(q + 10 > total_att, false) OR td_landed > td_att OR ctrl_sec > 900 OR sig_att > 200 OR coalesce(total_att > 300, false) OR td_att > 20)"


@query(_STATS + f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_FIGHT} AS fight, {_ROUND} AS round FROM s")
def suspicious_statistics(spark, d):
    """Whether a line would be a suspicious fight, or a suspicious round, by their bounds."""
    rows = _stats(spark, d).withColumn("fight", audit.suspicious_fight())
    names = {"sig_att": "sig_attempted", "total_landed": "tot_landed", "total_att": "tot_attempted", "td_att": "td_attempted"}
    rounds = rows.withColumnsRenamed(names).withColumn("passes", F.lit(0)).withColumn("round", audit.suspicious_round())
    return rounds.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "fight", "round")


@query(
    _STATS
    + f""", f AS (SELECT count(*) AS core_rows, count(*) - count(l_orderkey) AS missing_sides, 0 AS orphans, count(*) FILTER (WHERE l_suppkey % 19 = 0) AS unmapped, count(*) AS round_rows, count(*) FILTER (WHERE {_FIGHT}) AS suspicious_rows FROM s),
v AS (SELECT *, CASE WHEN core_rows = 0 OR missing_sides > 0 OR orphans > 0 THEN 'FAIL' WHEN unmapped > 500 OR unmapped > 0.1 * round_rows THEN 'WARN' ELSE 'PASS' END AS verdict FROM f),
n AS (SELECT CAST(row_number() OVER (ORDER BY name, n) AS INTEGER) AS i, '  name=' || name || ' n=' || n AS line FROM (SELECT 'Part ' || p_size AS name, count(*) AS n FROM part WHERE p_size > 40 GROUP BY 1 HAVING count(*) > 1) ORDER BY name, n LIMIT 5)
SELECT 0 AS section, i AS position, line FROM (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS i, unnest(['AUDIT', '  ' || rpad('core_rows', 28, ' ') || ' ' || core_rows, '  ' || rpad('missing_sides', 28, ' ') || ' ' || missing_sides, '  ' || rpad('orphans', 28, ' ') || ' ' || orphans,
'  ' || rpad('unmapped', 28, ' ') || ' ' || unmapped, '  ' || rpad('round_rows', 28, ' ') || ' ' || round_rows, '  ' || rpad('suspicious_rows', 28, ' ') || ' ' || suspicious_rows, 'STATUS: ' || verdict]) AS line FROM v)
UNION ALL SELECT 1, 0, 'DUPLICATE NAMES' UNION ALL SELECT 1, i, line FROM n UNION ALL SELECT 1, 1, '  none' WHERE NOT EXISTS (SELECT * FROM n)"""
)
def audit_report(spark, d):
    """A table written with its audit in the same pass, and the report as lines."""
    figures = {
        "core_rows": F.count("*"), "missing_sides": F.count_if(F.col("l_orderkey").isNull()), "orphans": F.count_if(F.lit(False)), "unmapped": F.count_if(F.col("l_suppkey") % 19 == 0), "round_rows": F.count("*"),
        "suspicious_rows": F.count_if(audit.suspicious_fight()),
    }
    report = audit.audited_write(_stats(spark, d), shared_folder(spark, "audited"), figures, lambda r: not r["core_rows"] or r["missing_sides"] > 0 or r["orphans"] > 0)
    row = audit.verdict(spark.createDataFrame([tuple(report.values())], ", ".join(f"{n} long" for n in report)))
    names = t(spark, d, "part").where("p_size > 40").groupBy(F.concat(F.lit("Part "), F.col("p_size")).alias("name")).agg(F.count("*").alias("n")).where("n > 1")
    return audit.report_lines(row, {"DUPLICATE NAMES": (names, ["name", "n"], 5)})


@query("""WITH p AS (SELECT lower(trim(c_mktsegment)) || ' ' || c_nationkey AS norm, 'id ' || c_custkey % 4 AS ident FROM customer)
SELECT norm, count(DISTINCT ident) AS n, list_sort(list(DISTINCT ident)) AS ids FROM p GROUP BY norm HAVING count(DISTINCT ident) >= 2""")
def ambiguous_names(spark, d):
    """Normalised names that several ids have."""
    k = F.col("c_custkey")
    rows = t(spark, d, "customer").select(F.concat(F.lower(F.trim("c_mktsegment")), F.lit(" "), F.col("c_nationkey")).alias("norm"), F.concat(F.lit("id "), k % 4).alias("ident"))
    return audit.ambiguous_names(rows, "norm", "ident")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem),
p AS (SELECT l_orderkey AS fight_id, n AS side, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_partkey % 2 END AS is_win, 100 * (l_partkey % 2) + 10 * (l_suppkey % 3) + 8 * (l_suppkey % 2) + CAST(l_quantity AS BIGINT) AS score FROM r WHERE n <= 2 + l_orderkey % 2),
g AS (SELECT fight_id, count(*) AS n, sum(is_win) AS wins, count(is_win) AS known, max(score) AS best, min(score) AS worst FROM p GROUP BY fight_id)
SELECT fight_id, CAST(side AS INTEGER) AS side, CAST(CASE WHEN n = 2 AND NOT (known = 2 AND coalesce(wins, -1) = 1) AND best > worst THEN CASE WHEN score = best THEN 1 ELSE 0 END ELSE is_win END AS INTEGER) AS is_win FROM p JOIN g USING (fight_id)""")
def repaired_outcomes(spark, d):
    """Fights of two sides that aren't won by exactly one get the winner their statistics speak for."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    rows = t(spark, d, "lineitem").withColumn("side", F.row_number().over(order)).where(F.col("side") <= 2 + F.col("l_orderkey") % 2)
    pairs = rows.select(
        F.col("l_orderkey").alias("fight_id"), "side", F.when(p % 4 == 0, None).otherwise(p % 2).cast("int").alias("is_win"), (p % 2).alias("kd"), (s % 3).alias("sub_att"), (s % 2).alias("td_landed"), F.col("l_quantity").alias("sig_landed"), F.lit(None).cast("int").alias("ctrl_sec"),
    )
    return audit.repaired_outcomes(pairs).select("fight_id", "side", "is_win")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'X' WHEN o_orderkey % 29 = 0 THEN 'F' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 29 = 0 THEN -1 ELSE o_custkey END AS o_custkey FROM orders
UNION ALL SELECT -1, 'new', -1""")
def merged_partitions(spark, d):
    """Orders by status with some moved, some replaced and one added; partitions without any are left alone."""
    path = shared_folder(spark, "merged")
    o, k = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), F.col("o_orderkey")
    o.write.partitionBy("o_orderstatus").parquet(path)
    new = o.where((k % 13 == 0) | (k % 29 == 0)).select("o_orderkey", F.lit(-1).cast("long").alias("o_custkey"), F.when(k % 13 == 0, "X").otherwise("F").alias("o_orderstatus"))
    added = spark.range(1).select(F.lit(-1).cast("long").alias("o_orderkey"), F.lit(-1).cast("long").alias("o_custkey"), F.lit("new").alias("o_orderstatus"))
    sinks.merge_partitions(spark, path, new.unionByName(added), ["o_orderkey"], "o_orderstatus")
    return spark.read.parquet(path)


@query("""WITH f AS (SELECT o_orderkey AS fight_url, 'F' || o_custkey AS fighter, o_orderdate, CAST(o_orderkey % 40 AS DOUBLE) AS sig, CAST(o_orderkey % 3 AS DOUBLE) AS kd FROM orders),
r AS (SELECT *, count(*) OVER w AS prior_rows, sum(sig) OVER w3 / nullif(count(sig) OVER w3, 0) AS sig3, sum(kd) OVER w / nullif(count(kd) OVER w, 0) AS kd_career, row_number() OVER (PARTITION BY fighter ORDER BY o_orderdate DESC, fight_url DESC) AS n
FROM f WINDOW w AS (PARTITION BY fighter ORDER BY o_orderdate, fight_url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w3 AS (PARTITION BY fighter ORDER BY o_orderdate, fight_url ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT fighter, fight_url, prior_rows, sig3 AS sig_landed_pm_avg_3, kd_career AS kd_pm_avg_career FROM r WHERE n = 1""")
def latest_features(spark, d):
    """The feature mart's newest row of each fighter: rates a minute over the fights before."""
    k = F.col("o_orderkey")
    o = t(spark, d, "orders")
    facts = o.select(
        k.alias("fight_url"), F.concat(F.lit("F"), F.col("o_custkey")).alias("fighter"), (k % 40 * 5).alias("sig_landed"), F.lit(None).cast("int").alias("td_landed"), F.lit(0).alias("ctrl_sec"), (k % 3 * 5).alias("kd"), F.lit(0).alias("sub_att"), F.lit(300).alias("fight_seconds"),
    )
    rolled = marts.features(facts, o.select(k.alias("fight_url"), F.col("o_orderdate").alias("fight_order")))
    return marts.latest_rollup(rolled).select("fighter", "fight_url", "prior_rows", "sig_landed_pm_avg_3", "kd_pm_avg_career")
