"""Queries of slates' analysis: all customers as players whose figures meet the bounds of tiers, some slates without ownership."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeframe.plans import slate
from strikeframe.plans.registry import query, t


def tiered_players(spark: SparkSession, d: str) -> DataFrame:
    """Customers in slates of 26 and fights of two, with whole figures; every fifth slate has no ownership."""
    k = F.col("c_custkey")
    mean = (40 + k % 17 * 4).cast("double")
    rows = t(spark, d, "customer").select(
        k.alias("player_id"), F.floor(k / 26).alias("slate_id"), F.concat(F.lit("f"), F.floor(k / 2)).alias("fight_id"), F.when(k % 2 == 0, "A").otherwise("B").alias("side"), "c_name",
        (6700 + k % 25 * 100).cast("int").alias("salary"), mean.alias("proj_mean"), (mean * 0.5).alias("proj_floor"), (mean * 2).alias("proj_ceiling"), (mean / 8).alias("value"), ((21 + k % 16) / 100.0).alias("risk"),
        (k % 9 * 4).cast("double").alias("own"), (F.lit(0.25) + k % 3 * 0.25).alias("p_win"),
    )
    return rows.withColumn("own_proj", F.when(F.col("slate_id") % 5 == 0, 0.0).otherwise(F.col("own"))).drop("own")


_PLAYERS = """
WITH p AS (
  SELECT c_custkey AS player_id, c_custkey // 26 AS slate_id, 'f' || c_custkey // 2 AS fight_id, CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS side, 6700 + c_custkey % 25 * 100 AS salary,
    CAST(40 + c_custkey % 17 * 4 AS DOUBLE) AS m, CAST(21 + c_custkey % 16 AS DOUBLE) / 100.0::DOUBLE AS risk, CASE WHEN c_custkey // 26 % 5 = 0 THEN 0.0::DOUBLE ELSE CAST(c_custkey % 9 * 4 AS DOUBLE) END AS own
  FROM customer
), g AS (
  SELECT slate_id, sum(own) AS total, quantile_cont(m / 8, [0.25, 0.5, 0.75]) AS v, quantile_cont(m * 2, [0.5, 0.75, 0.9]) AS c, quantile_cont(m * 0.5::DOUBLE, [0.5, 0.75]) AS f FROM p GROUP BY slate_id
), o AS (
  SELECT p.*, total > 0 AS known, v, c, f, CASE WHEN total > 0 THEN greatest(0.5::DOUBLE, least(55.0::DOUBLE, own * (260.0::DOUBLE / nullif(total, 0)))) ELSE own END AS own_proj FROM p JOIN g USING (slate_id)
), r AS (
  SELECT *, CASE WHEN known THEN (0.65::DOUBLE * (m * 2) + 0.35::DOUBLE * m) * (0.5::DOUBLE + m / 8 / 12.0::DOUBLE) / greatest(1.0::DOUBLE, own_proj) END AS leverage,
    CASE WHEN known THEN (0.7::DOUBLE * m + 0.3::DOUBLE * (m * 2)) / greatest(1.0::DOUBLE, own_proj) END AS pivot_score
  FROM o
)
"""


@query(
    _PLAYERS
    + """SELECT player_id, slate_id, own_proj, leverage, pivot_score, CASE WHEN own_proj >= 35 THEN 'Mega' WHEN own_proj >= 22 THEN 'High' WHEN own_proj >= 12 THEN 'Mid' ELSE 'Low' END AS own_tier,
CASE WHEN salary <= 7200 THEN 'Punt' WHEN salary <= 8600 THEN 'Mid' ELSE 'Stud' END AS tier_salary, CASE WHEN m / 8 >= v[3] THEN 'Elite' WHEN m / 8 >= v[2] THEN 'Strong' WHEN m / 8 >= v[1] THEN 'OK' ELSE 'Bad' END AS tier_value,
CASE WHEN m * 2 >= c[3] THEN 'SlateBreaker' WHEN m * 2 >= c[2] THEN 'GPP' WHEN m * 2 >= c[1] THEN 'Neutral' ELSE 'Low' END AS tier_ceiling, CASE WHEN m * 0.5::DOUBLE >= f[2] THEN 'Safe' WHEN m * 0.5::DOUBLE >= f[1] THEN 'OK' ELSE 'Shaky' END AS tier_floor,
CASE WHEN risk <= 0.27::DOUBLE THEN 'Low' WHEN risk <= 0.33::DOUBLE THEN 'Med' ELSE 'High' END AS tier_risk FROM r"""
)
def slate_analysis(spark, d):
    """Ownership, leverage and tiers of all customers in their slates."""
    out = slate.analysed(tiered_players(spark, d), "slate_id")
    return out.select("player_id", "slate_id", "own_proj", "leverage", "pivot_score", "own_tier", "tier_salary", "tier_value", "tier_ceiling", "tier_floor", "tier_risk")


@query(
    _PLAYERS
    + """, b AS (UNPIVOT (SELECT slate_id, player_id, m AS top_mean, m * 2 AS top_ceiling, m / 8 AS top_value, m * 0.5::DOUBLE AS best_floor, risk AS highest_risk, own_proj AS top_ownership, coalesce(leverage, 0.0::DOUBLE) AS top_leverage FROM r)
ON top_mean, top_ceiling, top_value, best_floor, highest_risk, top_ownership, top_leverage INTO NAME board VALUE figure),
w AS (SELECT slate_id, board, player_id, figure, CAST(row_number() OVER (PARTITION BY slate_id, board ORDER BY figure DESC, player_id) AS INTEGER) AS rank FROM b) SELECT * FROM w WHERE rank <= 10"""
)
def slate_leaders(spark, d):
    """The seven boards of every slate."""
    return slate.leaderboards(slate.owned(tiered_players(spark, d), "slate_id"), "slate_id").select("slate_id", "board", "player_id", "figure", "rank")


@query(
    _PLAYERS
    + """, s AS (SELECT slate_id, fight_id, player_id, side, m, own_proj, v, c, row_number() OVER (PARTITION BY slate_id, fight_id ORDER BY side, player_id) AS n FROM r),
x AS (SELECT CAST(slate_id AS VARCHAR) AS slate, fight_id, max(CASE WHEN n = 1 THEN player_id END) AS a_id, max(CASE WHEN n = 2 THEN player_id END) AS b_id, coalesce(max(CASE WHEN n = 1 THEN m END), 0) AS am, coalesce(max(CASE WHEN n = 2 THEN m END), 0) AS bm,
coalesce(max(CASE WHEN n = 1 THEN own_proj END), 0) AS ao, coalesce(max(CASE WHEN n = 2 THEN own_proj END), 0) AS bo, any_value(v) AS v, any_value(c) AS c FROM s GROUP BY ALL)
SELECT slate, fight_id, a_id, b_id, am + bm AS fight_mean, greatest(am, bm) * 2 AS fight_ceiling, 0.6::DOUBLE * (am + bm) + 0.4::DOUBLE * (am * 2 + bm * 2) AS stack_score, ao + bo AS fight_own, CASE WHEN ao >= bo THEN 'A' ELSE 'B' END AS chalk_side, greatest(ao, bo) AS chalk_own,
list_filter([CASE WHEN greatest(am, bm) * 2 >= c[3] THEN 'HighCeilingWinner' END, CASE WHEN greatest(am, bm) / 8 >= v[3] THEN 'ValueSide' END, CASE WHEN least(am, bm) / 8 <= v[1] AND greatest(am, bm) / 8 <= v[2] THEN 'LowValueFight' END,
CASE WHEN ao + bo >= 55 THEN 'ChalkFight' END, CASE WHEN greatest(ao, bo) >= 35 THEN 'ChalkSide:' || CASE WHEN ao >= bo THEN 'A' ELSE 'B' END END], lambda z: z IS NOT NULL) AS flags FROM x"""
)
def slate_fights(spark, d):
    """Every fight of every slate with its sums, its more popular side and flags."""
    return slate.fight_report(slate.owned(tiered_players(spark, d), "slate_id"), "slate_id")


@query(
    """WITH p AS (SELECT c_custkey AS player_id, lower(trim(c_name)) AS k, 0.25::DOUBLE + c_custkey % 3 * 0.25::DOUBLE AS p FROM customer),
o AS (SELECT lower(trim(c_name)) AS k, max_by(CASE WHEN o_orderkey % 2 = 0 THEN -(110 + o_orderkey % 300) ELSE 110 + o_orderkey % 300 END, ROW(o_orderdate, o_orderkey)) AS odds FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 = 0 GROUP BY 1)
SELECT player_id, odds, CASE WHEN odds IS NULL THEN p ELSE (CASE WHEN odds < 0 THEN -odds / (100.0::DOUBLE - odds) ELSE 100.0::DOUBLE / (100.0::DOUBLE + odds) END) * 0.65::DOUBLE + p * (1.0::DOUBLE - 0.65::DOUBLE) END AS p_win FROM p LEFT JOIN o USING (k)"""
)
def market_odds(spark, d):
    """Chances to win blended with the newest odds, where there are any."""
    k = F.col("o_orderkey")
    names = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit(" "), F.upper("c_name")).alias("fighter_name"))
    odds = t(spark, d, "orders").where(k % 3 == 0).join(names, "o_custkey").select(
        "fighter_name", F.when(k % 2 == 0, -(110 + k % 300)).otherwise(110 + k % 300).cast("int").alias("moneyline"), F.struct("o_orderdate", "o_orderkey").alias("seq")
    )
    players = tiered_players(spark, d).select("player_id", F.col("c_name").alias("player_name"), "p_win")
    return slate.with_odds(players, odds, "seq").select("player_id", F.col("moneyline").cast("long").alias("odds"), "p_win")
