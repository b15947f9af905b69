"""Slates: fights, analysis and lineups.

Order of stages: simulate, blend with the market, analyse (which sets ownership), then optimize on the analysed rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikeframe.functions import domain as D
from strikeframe.functions.text import game_info, pair_key


def fight_map(players: DataFrame) -> DataFrame:
    """fight_id, side and opponent of each player. The first two of a fight are its sides, more are marked ambiguous;
    a player alone in a fight is unmatched but keeps the fight; text of another form gives no fight."""
    info = game_info(F.col("game_info"))
    keyed = players.withColumn("fight_id", F.when(info.isNotNull(), pair_key(info["away"], info["home"])))
    w = Window.partitionBy("fight_id").orderBy("player_id")
    n = F.count("*").over(Window.partitionBy("fight_id"))
    at = F.row_number().over(w)
    mate = F.when(at == 1, F.lead("player_name").over(w)).when(at == 2, F.lag("player_name").over(w))
    status = F.when(F.col("fight_id").isNull() | (n == 1), "unmatched").when(at > 2, "ambiguous").otherwise("ok")
    side = F.when(F.col("fight_id").isNull() | (at > 2), None).when(at == 1, "A").otherwise("B")
    return keyed.withColumns({"side": side, "opponent": F.when(F.col("fight_id").isNotNull(), mate), "status": status})


def with_odds(players: DataFrame, odds: DataFrame | None, sequence: str = "moneyline") -> DataFrame:
    """Blends p_win with the market's where odds are known, the last by ``sequence``; without a table of odds, p_win stays."""
    if odds is None:
        return players
    last = odds.groupBy(F.lower(F.trim("fighter_name")).alias("__k__")).agg(F.max_by("moneyline", F.struct(sequence, "moneyline")).alias("moneyline"))
    out = players.withColumn("__k__", F.lower(F.trim("player_name"))).join(last, "__k__", "left").drop("__k__")
    return out.withColumn("p_win", D.blend(D.implied_probability(F.col("moneyline")), F.col("p_win")))


def player_pool(players: DataFrame, projections: DataFrame | None = None) -> DataFrame:
    """Fight blocks of a slate file's players (``readers.slate``): fight_id, fighters (dearest first) and how many are projected.

    A player's projection is that of the model, by id, where there is one; else the average, or what the salary is
    worth. Players without a fight of the usual text form a block by that text.
    """
    baseline = D.fallback_projection(F.col("salary").cast("double"), F.col("avg_points_per_game"))
    rows = fight_map(players).withColumn("fight_id", F.coalesce("fight_id", "game_info", F.lit("")))
    if projections is not None:
        rows = rows.join(projections.select("player_id", F.col("proj_mean").alias("__model__")), "player_id", "left")
    else:
        rows = rows.withColumn("__model__", F.lit(None).cast("double"))
    rows = rows.withColumns({"proj": F.coalesce("__model__", baseline), "modelled": F.col("__model__").isNotNull()})
    one = F.struct((-F.col("salary")).alias("o"), "player_id", "player_name", "salary", "opponent", "proj", "modelled")
    blocks = rows.groupBy("fight_id").agg(F.sort_array(F.collect_list(one)).alias("fighters"), F.count_if("modelled").alias("n_modelled"))
    return blocks.withColumn("fighters", F.transform("fighters", lambda f: f.dropFields("o")))


#: What ownership adds up to, its bounds, and the bounds of tiers.
OWN_TOTAL, LEAST_OWN, MOST_OWN = 260.0, 0.5, 55.0
MEGA_OWN, HIGH_OWN, MID_OWN = 35.0, 22.0, 12.0
LOW_RISK, MID_RISK = 0.27, 0.33
PUNT_SALARY, MID_SALARY = 7200, 8600
CHALK_FIGHT, CHALK_SIDE = 55.0, 35.0


def _figure(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def marks(players: DataFrame, slate: str) -> DataFrame:
    """A slate's ownership sum and percentiles: a row for each slate, under the name ``__slate__``."""
    quarters = {"value": [0.25, 0.5, 0.75], "proj_ceiling": [0.5, 0.75, 0.9], "proj_floor": [0.5, 0.75], "own_proj": [0.5, 0.75, 0.9]}
    return players.groupBy(F.coalesce(F.col(slate).cast("string"), F.lit("")).alias("__slate__")).agg(
        F.count("*").alias("count"), F.sum(_figure("own_proj")).alias("own_sum"), *[F.percentile(_figure(c), q).alias(f"p_{c}") for c, q in quarters.items()]
    )


def owned(players: DataFrame, slate: str, total: float = OWN_TOTAL) -> DataFrame:
    """Ownership scaled to the slate's total and clamped, with its tier, leverage and pivot score.

    A slate without any ownership keeps what it has, and has neither leverage nor pivot scores.
    """
    sums = players.groupBy(F.coalesce(F.col(slate).cast("string"), F.lit("")).alias("__slate__")).agg(F.sum(_figure("own_proj")).alias("__own__"))
    rows = players.withColumn("__slate__", F.coalesce(F.col(slate).cast("string"), F.lit(""))).join(sums, "__slate__").drop("__slate__")
    any_ = F.col("__own__") > 0
    own = F.when(any_, D.clamp(_figure("own_proj") * (total / F.nullif(F.col("__own__"), F.lit(0.0))), LEAST_OWN, MOST_OWN)).otherwise(_figure("own_proj"))
    rows = rows.withColumn("own_proj", own)
    o, m, c = F.col("own_proj"), _figure("proj_mean"), _figure("proj_ceiling")
    return rows.withColumns(
        {
            "own_tier": F.when(o >= MEGA_OWN, "Mega").when(o >= HIGH_OWN, "High").when(o >= MID_OWN, "Mid").otherwise("Low"),
            "leverage": F.when(any_, D.ownership_leverage(c, m, _figure("value"), o)),
            "pivot_score": F.when(any_, D.pivot_score(c, m, o)),
        }
    ).drop("__own__")


def analysed(players: DataFrame, slate: str, total: float = OWN_TOTAL) -> DataFrame:
    """``owned`` players with the tiers of salary, value, ceiling, floor and risk within their slate."""
    rows = owned(players, slate, total).withColumn("__slate__", F.coalesce(F.col(slate).cast("string"), F.lit("")))
    tops = marks(players, slate).drop("count", "own_sum", "p_own_proj")
    v, c, f, r, s = (_figure(x) for x in ("value", "proj_ceiling", "proj_floor", "risk", "salary"))
    at = lambda name, k: F.col(f"p_{name}")[k]
    return rows.join(tops, "__slate__").withColumns(
        {
            "tier_salary": F.when(s <= PUNT_SALARY, "Punt").when(s <= MID_SALARY, "Mid").otherwise("Stud"),
            "tier_value": F.when(v >= at("value", 2), "Elite").when(v >= at("value", 1), "Strong").when(v >= at("value", 0), "OK").otherwise("Bad"),
            "tier_ceiling": F.when(c >= at("proj_ceiling", 2), "SlateBreaker").when(c >= at("proj_ceiling", 1), "GPP").when(c >= at("proj_ceiling", 0), "Neutral").otherwise("Low"),
            "tier_floor": F.when(f >= at("proj_floor", 1), "Safe").when(f >= at("proj_floor", 0), "OK").otherwise("Shaky"),
            "tier_risk": F.when(r <= LOW_RISK, "Low").when(r <= MID_RISK, "Med").otherwise("High"),
        }
    ).drop("__slate__", "p_value", "p_proj_ceiling", "p_proj_floor")


def fight_report(players: DataFrame, slate: str, side: str = "side") -> DataFrame:
    """A row for each fight of a slate, of ``owned`` players: its first two sides, sums, the more popular side, and flags."""
    of = players.where(F.coalesce(F.col("fight_id"), F.lit("")) != "")
    one = F.struct(F.coalesce(F.col(side), F.lit("")).alias("side"), "player_id", *[_figure(c).alias(c) for c in ("proj_mean", "proj_ceiling", "value", "own_proj")])
    fights = of.groupBy(F.coalesce(F.col(slate).cast("string"), F.lit("")).alias("__slate__"), "fight_id").agg(F.slice(F.sort_array(F.collect_list(one)), 1, 2).alias("ps"))

    def each(name: str) -> list[Column]:
        return [F.coalesce(F.get("ps", F.lit(k))[name], F.lit(0.0)) for k in (0, 1)]

    mean, ceiling, value, own = (each(c) for c in ("proj_mean", "proj_ceiling", "value", "own_proj"))
    tops = marks(players, slate).select("__slate__", "p_value", "p_proj_ceiling")
    low, middle, high, best = F.col("p_value")[0], F.col("p_value")[1], F.col("p_value")[2], F.col("p_proj_ceiling")[2]
    chalk = F.when(own[0] >= own[1], "A").otherwise("B")
    flags = [
        (F.greatest(*ceiling) >= best, F.lit("HighCeilingWinner")), (F.greatest(*value) >= high, F.lit("ValueSide")), ((F.least(*value) <= low) & (F.greatest(*value) <= middle), F.lit("LowValueFight")),
        (own[0] + own[1] >= CHALK_FIGHT, F.lit("ChalkFight")), (F.greatest(*own) >= CHALK_SIDE, F.concat(F.lit("ChalkSide:"), chalk)),
    ]
    return fights.join(tops, "__slate__").select(
        F.col("__slate__").alias("slate"), "fight_id", F.get("ps", F.lit(0))["player_id"].alias("a_id"), F.get("ps", F.lit(1))["player_id"].alias("b_id"), (mean[0] + mean[1]).alias("fight_mean"),
        F.greatest(*ceiling).alias("fight_ceiling"), D.stack_score(mean[0] + mean[1], ceiling[0] + ceiling[1]).alias("stack_score"), (own[0] + own[1]).alias("fight_own"), chalk.alias("chalk_side"),
        F.greatest(*own).alias("chalk_own"), F.array_compact(F.array(*[F.when(test, name) for test, name in flags])).alias("flags"),
    )


def fights(players: DataFrame) -> DataFrame:
    """Both sides of each fight in a row: sums, ceiling, stack score, the more popular side, members by salary."""
    return players.where("fight_id is not null").groupBy("fight_id").agg(
        F.sum("proj_mean").alias("mean_sum"),
        F.sum("proj_ceiling").alias("ceiling_sum"),
        F.max("proj_ceiling").alias("fight_ceiling"),
        D.stack_score(F.sum("proj_mean"), F.sum("proj_ceiling")).alias("stack"),
        F.max_by("player_name", F.struct("own_proj", "player_name")).alias("chalk_side"),
        F.reverse(F.array_sort(F.collect_list(F.struct("salary", "player_name")))).alias("members"),
    )


#: The boards of a slate and the figure that each goes by.
BOARDS = {
    "top_mean": "proj_mean", "top_ceiling": "proj_ceiling", "top_value": "value", "best_floor": "proj_floor", "highest_risk": "risk", "top_ownership": "own_proj", "top_leverage": "leverage",
}


def leaderboards(players: DataFrame, slate: str, n: int = 10) -> DataFrame:
    """The first n players of each board of each slate, of ``owned`` players; ties go to the smaller id, missing figures count as 0."""
    long = players.select(slate, "player_id", *[_figure(c).alias(b) for b, c in BOARDS.items()]).unpivot([slate, "player_id"], list(BOARDS), "board", "figure")
    w = Window.partitionBy(slate, "board").orderBy(F.desc("figure"), "player_id")
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def summaries(players: DataFrame, slate: str) -> DataFrame:
    """A row for each slate of ``owned`` players: counts, percentiles, and the first of each board."""
    firsts = [F.min_by("player_id", F.struct(-_figure(c), "player_id")).alias(b) for b, c in BOARDS.items()]
    marked = [F.percentile(_figure(c), p).alias(n) for n, c, p in (("value75", "value", 0.75), ("ceiling90", "proj_ceiling", 0.9), ("own90", "own_proj", 0.9))]
    return players.groupBy(slate).agg(F.count("*").alias("players"), F.countDistinct("fight_id").alias("fights"), *marked, *firsts)


def feasible_lineups(
    players: DataFrame, score: Column, size: int = 6, cap: int = 50_000, floor: int = 47_000, max_avg_risk: float = 0.42, one_per_fight: bool = True
) -> DataFrame:
    """All sets of ``size`` players within the salary range and the risk, of distinct fights; members, salary, score.

    A join of rising positions for each seat, cut short as soon as the cheapest or dearest rest can't make the range.
    The pool is one slate, some dozens of players, so each join has it on the small side by Spark's own estimate. For
    the best sets alone see ``lineups.optimized``.
    """
    valid = players.where((F.col("salary") > 0) & (F.length("player_id") > 0) & (F.length("fight_id") > 0))
    pool = valid.select("player_id", "fight_id", F.col("salary").cast("long").alias("salary"), F.coalesce("risk", F.lit(0.0)).alias("risk"), score.alias("s"))
    pool = pool.withColumn("at", F.row_number().over(Window.orderBy("player_id"))).persist()
    cheap, dear = pool.agg(F.min("salary"), F.max("salary")).first()
    if cheap is None:
        cheap = dear = 0
    sets = pool.select("at", F.array("player_id").alias("members"), F.array("fight_id").alias("held"), "salary", "risk", F.col("s").alias("score"))
    for seat in range(2, size + 1):
        left = size - seat
        p = pool.select(*[F.col(c).alias(f"p_{c}") for c in ("player_id", "fight_id", "salary", "risk", "s", "at")])
        total = F.col("salary") + F.col("p_salary")
        rules = [F.col("p_at") > F.col("at"), total + left * cheap <= cap, total + left * dear >= floor]
        if one_per_fight:
            rules.append(~F.array_contains("held", F.col("p_fight_id")))
        sets = sets.join(p, reduce(lambda a, b: a & b, rules)).select(
            F.col("p_at").alias("at"),
            F.concat("members", F.array("p_player_id")).alias("members"),
            F.concat("held", F.array("p_fight_id")).alias("held"),
            total.alias("salary"),
            (F.col("risk") + F.col("p_risk")).alias("risk"),
            (F.col("score") + F.col("p_s")).alias("score"),
        )
    sets = sets.where(F.col("salary").between(floor, cap) & (F.col("risk") <= size * max_avg_risk))
    return sets.select("members", "salary", "risk", "score")
