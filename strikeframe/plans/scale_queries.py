"""Queries over hot keys and large groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikeframe.operators import aggregates, windows
from strikeframe.plans.registry import query, t


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 0 WHEN o_orderkey % 11 > 0 THEN o_custkey END AS k, o_orderdate, CASE WHEN o_orderkey % 5 > 0 THEN CAST(round(o_totalprice) AS BIGINT) END AS v FROM orders)
SELECT o_orderkey, k, CAST(sum(v) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS DOUBLE) / nullif(count(v) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS v_avg_3,
CAST(sum(v) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS DOUBLE) / nullif(count(v) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS v_avg_10,
CAST(sum(v) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE) / nullif(count(v) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS v_avg_career, count(*) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_rows
FROM r WINDOW w AS (PARTITION BY k ORDER BY o_orderdate, o_orderkey)""")
def rolling_prior_hot(spark, d):
    """Rolling averages where one key has half of all rows, some rows have no key and some no figure."""
    k = F.col("o_orderkey")
    key = F.when(k % 2 == 0, F.lit(0).cast("long")).when(k % 11 > 0, F.col("o_custkey"))
    rows = t(spark, d, "orders").select("o_orderkey", key.alias("k"), "o_orderdate", F.when(k % 5 > 0, F.round("o_totalprice").cast("long")).alias("v"))
    return windows.rolling_prior_split(rows, ["k"], ["o_orderdate", "o_orderkey"], ["v"], (3, 10)).drop("o_orderdate", "v")


@query("""SELECT l_returnflag, quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.25) AS p25, quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5) AS p50, quantile_cont(CAST(l_quantity AS DOUBLE), 0.9) AS q90
FROM lineitem GROUP BY l_returnflag""")
def percentiles_of_large_groups(spark, d):
    """Exact percentiles by rank; a flag's rows are never in one buffer."""
    rows = t(spark, d, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    price = aggregates.percentiles_by_rank(rows, ["l_returnflag"], "l_extendedprice", (0.25, 0.5))
    return price.join(aggregates.percentiles_by_rank(rows, ["l_returnflag"], "l_quantity", (0.9,)).withColumnRenamed("p90", "q90"), "l_returnflag")
