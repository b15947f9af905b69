"""Fact and feature marts from conformed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strikeframe.functions.parse import clock_seconds, fight_seconds, pair_attempted, pair_landed, won
from strikeframe.functions.text import is_furniture
from strikeframe.operators.aggregates import pivot_max
from strikeframe.operators.reshape import mirrored
from strikeframe.operators.windows import rolling_prior

#: The keys that fight totals are reported under.
PAIRS = {"sig": "Significant Strikes", "tot": "Total Strikes", "td": "Takedowns"}
SCALARS = {"kd": "Knockdowns", "sub_att": "Submissions Attempted", "rev": "Reversals", "passes": "Passes"}


def fighter_fights(fights: DataFrame, totals: DataFrame) -> DataFrame:
    """Two rows of each fight, with outcome and totals."""
    f = fights.withColumn("winner_key", F.lower(F.trim("winner")))
    outcome = lambda c: F.when(F.col("winner_key") == F.lower(F.trim(c)), 1).when(F.col("winner_key").isNull() | (F.col("winner_key") == ""), None).otherwise(0)
    known = F.col("winner_key").isin("") | (F.col("winner_key") == F.lower(F.trim("fighter_a"))) | (F.col("winner_key") == F.lower(F.trim("fighter_b")))
    f = f.withColumn("win_a", F.when(known, outcome("fighter_a"))).withColumn("win_b", F.when(known, outcome("fighter_b")))
    common = ["fight_url", "weight_class", "method", "round", "time"]
    rows = mirrored(f, common, {"fighter": "fighter_a", "opponent": "fighter_b", "is_win": "win_a"}, {"fighter": "fighter_b", "opponent": "fighter_a", "is_win": "win_b"})
    key, value = F.col("stat_key"), F.col("a_value")
    columns = {}
    for c, k in PAIRS.items():
        columns |= {f"{c}_landed": (key == k, F.coalesce("a_landed", pair_landed(value))), f"{c}_attempted": (key == k, F.coalesce("a_attempted", pair_attempted(value)))}
    columns |= {c: (key == k, F.coalesce(F.col("a_landed"), value.try_cast("int"))) for c, k in SCALARS.items()}
    columns["ctrl_sec"] = (F.contains(F.lower(key), F.lit("control")), clock_seconds(value))
    wide = pivot_max(totals.withColumn("fighter", F.trim("fighter")), ["fight_url", "fighter"], columns)
    named = rows.withColumn("fighter", F.trim("fighter")).where("fight_url is not null and fight_url <> ''").where(~is_furniture(F.col("fighter")))
    return named.join(wide, ["fight_url", "fighter"], "left").withColumn("fight_seconds", fight_seconds(F.col("round"), F.col("time")))


def features(facts: DataFrame, order: DataFrame) -> DataFrame:
    """Facts with rolling features of the fighter's earlier fights; ``order`` has fight_url and fight_order."""
    minutes = F.greatest(F.col("fight_seconds") / 60.0, F.lit(1 / 60))
    rates = {f"{c}_pm": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / minutes for c in ("sig_landed", "td_landed", "ctrl_sec", "kd", "sub_att")}
    rows = facts.join(order.select("fight_url", "fight_order"), "fight_url", "left").withColumns(rates)
    return rolling_prior(rows, ["fighter"], ["fight_order", "fight_url"], list(rates))


def latest_rollup(rolled: DataFrame, by: str = "fight_order") -> DataFrame:
    """The last row of each fighter, by the fights' order or, as a compatible choice, by their URL."""
    w = Window.partitionBy("fighter").orderBy(F.desc(by), F.desc("fight_url"))
    return rolled.withColumn("__n__", F.row_number().over(w)).where("__n__ = 1").drop("__n__")


def outcome_known(facts: DataFrame) -> DataFrame:
    """Facts whose outcome text is normal: 1, 0 or null."""
    return facts.withColumn("is_win", won(F.col("is_win")))
