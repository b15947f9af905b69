"""Sports and slate arithmetic over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low: float, high: float) -> Column:
    """Within [low, high]; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def inches(c: Column) -> Column:
    """Lengths over 100 are centimetres."""
    return F.when(c > 100, F.round(c / 2.54, 2)).otherwise(c)


def pounds(c: Column) -> Column:
    """Weights under 120 are kilograms (a true 115 lb is taken for kg, too)."""
    return F.when(c < 120, F.round(c * 2.2046226218, 2)).otherwise(c)


def completeness(*columns: Column) -> Column:
    """How many of the texts are not blank."""
    total = F.lit(0)
    for c in columns:
        total = total + F.coalesce((F.length(F.trim(c.cast("string"))) > 0).cast("int"), F.lit(0))
    return total


def implied_probability(moneyline: Column) -> Column:
    """Of American odds; null for 0 and null."""
    m = moneyline.cast("double")
    return F.when(m < 0, -m / (100.0 - m)).when(m > 0, 100.0 / (100.0 + m))


def blend(market: Column, model: Column, weight: float = 0.65) -> Column:
    return F.coalesce(market * weight + model * (1.0 - weight), model)


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clamp(c, -50.0, 50.0)))


def dot(x: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def logit(x: Column, w: Column, b: Column) -> Column:
    return sigmoid(dot(x, w) + b)


def ownership_guess(p_win: Column, finish: Column) -> Column:
    return clamp(24.0 * p_win + 18.0 * finish, 3.0, 42.0)


def standardized(mean: Column, floor: Column, ceiling: Column, stdev: Column, salary: Column) -> Column:
    """Simulated points brought to the optimizer's scale, with value for 1,000 of salary and risk."""
    m, s = mean * 0.72, stdev * 0.78
    return F.struct(
        m.alias("proj_mean"),
        (floor * 0.68).alias("proj_floor"),
        (ceiling * 0.78).alias("proj_ceiling"),
        s.alias("proj_stdev"),
        F.when(salary > 0, m / (salary / 1000.0)).otherwise(0.0).alias("value"),
        clamp(s / F.greatest(F.lit(1.0), m), 0.0, 1.0).alias("risk"),
    )


def leverage_bonus(ceiling: Column, mean: Column, own: Column, weight: float) -> Column:
    return F.when(own > 0, weight * (ceiling + mean) / F.greatest(F.lit(1.0), own)).otherwise(0.0)


def player_score(mode: str = "gpp", weight: float = 0.0) -> Column:
    """A player's score in a lineup, from the columns of ``standardized`` and p_win, finish_equity and own_proj."""
    c = {n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in ("proj_mean", "proj_floor", "proj_ceiling", "value", "risk", "p_win", "finish_equity", "own_proj")}
    if mode == "cash":
        return 0.95 * c["proj_floor"] + 0.35 * c["proj_mean"] + 1.1 * c["value"] + 18.0 * c["p_win"] - 10.0 * c["risk"]
    bonus = leverage_bonus(c["proj_ceiling"], c["proj_mean"], c["own_proj"], weight) if weight > 0 else F.lit(0.0)
    return c["proj_mean"] + 0.3 * c["proj_ceiling"] + 1.5 * c["value"] + 14.0 * c["p_win"] + 22.0 * c["finish_equity"] + bonus - 12.0 * c["risk"]


def ownership_leverage(ceiling: Column, mean: Column, value: Column, own: Column) -> Column:
    return (0.65 * ceiling + 0.35 * mean) * (0.5 + value / 12.0) / F.greatest(F.lit(1.0), own)


def pivot_score(ceiling: Column, mean: Column, own: Column) -> Column:
    return (0.7 * mean + 0.3 * ceiling) / F.greatest(F.lit(1.0), own)


def stack_score(mean_sum: Column, ceiling_sum: Column) -> Column:
    return 0.6 * mean_sum + 0.4 * ceiling_sum


def repair_score(kd: Column, sub: Column, td: Column, sig: Column, ctrl: Column) -> Column:
    """How much a side's statistics speak for its win."""
    part = lambda c, w: w * F.coalesce(c.cast("double"), F.lit(0.0))
    return part(kd, 100.0) + part(sub, 10.0) + part(td, 8.0) + part(sig, 1.0) + part(ctrl, 0.01)


def fallback_projection(salary: Column, average: Column) -> Column:
    return F.when(average > 0, average).otherwise(salary / 1000.0 * 6.5)


def gates(p_win: Column) -> Column:
    """What a chance to win leaves of a projection's mean, floor, ceiling and deviation."""
    return F.struct(
        (0.35 + 0.65 * p_win).alias("mean"), F.greatest(F.lit(0.30), p_win).alias("floor"), (0.55 + 0.45 * p_win).alias("ceiling"), (0.70 + 0.30 * p_win).alias("stdev")
    )
