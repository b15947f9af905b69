"""Projections of a slate's players: opponents found, names resolved, newest features compared by the models.

Simulated points are not made here: ``scaled`` takes the points of any source and brings them to the optimizer's scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeframe.functions import domain as D
from strikeframe.functions import names as N
from strikeframe.functions import text as X
from strikeframe.functions.parse import payload
from strikeframe.operators import joins
from strikeframe.plans.model import FEATURES
from strikeframe.sources.scratch import written

#: Bounds of the models' chances, and what stands for them where a side isn't known.
WIN_BOUNDS, FINISH_BOUNDS = (0.05, 0.95), (0.02, 0.80)
UNKNOWN = {"p_win": 0.50, "p_finish_given_win": 0.35, "finish_equity": 0.175}
#: The pace of a fight by minute, with its bounds, and the pace of an unknown side.
PACE = {"sig_land": (0.5, 8.0, 3.0), "td_land": (0.0, 2.5, 0.6), "ctrl_sec": (0.0, 90.0, 20.0), "kd": (0.0, 0.35, 0.06), "sub_att": (0.0, 1.5, 0.25)}
#: Sources of aliases, and the least similarity of a name that is taken for another.
ALIAS_SOURCES, LEAST_SIMILAR = ("dk", "ss"), 92.0


def with_opponents(players: DataFrame) -> DataFrame:
    """opponent_name as given, else the other side of game_info, as the full name of the slate's one other player that it ends.

    Players have slate_id, player_name, opponent_name and game_info. Every ending of a name is a join key; of its
    players only the count and the two ends of their order are kept, which is enough to tell whether one is left
    without the player itself. A token that no or several others have stays as it is; without any, it is null.
    """
    own = X.norm_name_folded(F.col("player_name"))
    sides = N.matchup(F.col("game_info"))
    away, home = X.norm_name_folded(sides["away"]), X.norm_name_folded(sides["home"])
    is_side = lambda side: (own == side) | (X.last_word(own) == side)
    other = F.when(is_side(home) & ~is_side(away), sides["away"]).otherwise(sides["home"])
    keyed = players.withColumns({"__own__": own, "__slate__": F.coalesce(F.col("slate_id").cast("string"), F.lit("")), "__token__": F.coalesce(N.first_filled(F.col("opponent_name")), other)})

    words = F.split("__own__", " ")
    endings = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), " "))
    named = keyed.where("__own__ <> ''").groupBy("__slate__", "__own__").agg(F.min("player_name").alias("name"))
    ended = named.select("__slate__", F.explode(endings).alias("__form__"), F.struct(F.col("__own__").alias("own"), "name").alias("who"))
    ends = ended.groupBy("__slate__", "__form__").agg(F.count("*").alias("__n__"), F.min("who").alias("__lo__"), F.max("who").alias("__hi__"))

    joined = keyed.withColumn("__form__", X.norm_name_folded(F.col("__token__"))).join(ends, ["__slate__", "__form__"], "left")
    n, lo, hi = F.col("__n__"), F.col("__lo__"), F.col("__hi__")
    found = F.when((n == 1) & (lo["own"] != F.col("__own__")), lo["name"]).when((n == 2) & (lo["own"] == F.col("__own__")), hi["name"]).when((n == 2) & (hi["own"] == F.col("__own__")), lo["name"])
    return joined.withColumn("opponent_name", F.coalesce(found, "__token__")).select(*players.columns)


def resolved(names: DataFrame, fighters: DataFrame, aliases: DataFrame, least: float = LEAST_SIMILAR) -> DataFrame:
    """name, fighter_id, method (alias, exact or fuzzy) and confidence of each name that is some fighter's.

    names: name; fighters: fighter_id and name_norm; aliases: source, raw_name and fighter_id. In turn a name is looked
    up among the aliases as written and normalised, and among the fighters normalised and without a suffix; of several
    fighters of one name the smallest id is taken. Only what is left then is compared by similarity.
    """
    by_alias = aliases.where(F.col("source").isin(*ALIAS_SOURCES) & (F.trim("fighter_id") != "")).select(F.lit("alias").alias("kind"), F.col("raw_name").alias("form"), "fighter_id")
    by_name = fighters.where(F.trim("name_norm") != "").select(F.lit("exact").alias("kind"), F.trim("name_norm").alias("form"), "fighter_id")
    keys = by_alias.union(by_name).groupBy("kind", "form").agg(F.min(F.col("fighter_id").cast("string")).alias("fighter_id"))

    norm = X.norm_name_folded(F.col("name"))
    bare = X.strip_suffix(norm)
    asked = names.where(N.first_filled(F.col("name")).isNotNull()).select("name").distinct()
    look = lambda kind, form, sure: F.struct(F.lit(kind).alias("kind"), form.alias("form"), F.lit(sure).alias("confidence"))
    looks = asked.select("name", F.posexplode(F.array(look("alias", F.trim("name"), 1.0), look("alias", norm, 1.0), look("exact", norm, 1.0), look("exact", bare, 0.98))).alias("turn", "look"))
    hits = looks.select("name", "turn", "look.*").join(keys, ["kind", "form"])
    first = hits.groupBy("name").agg(F.min(F.struct("turn", "fighter_id", "kind", "confidence")).alias("m")).select("name", "m.fighter_id", F.col("m.kind").alias("method"), "m.confidence")

    # both are read several times over
    rest = written(asked.join(first, "name", "left_anti").select("name", bare.alias("l")).where("l <> ''"), "projection-rest")
    known = written(keys.where("kind = 'exact'").select(F.col("form").alias("r"), "fighter_id"), "projection-known")
    like = joins.fuzzy_top_k(rest.select("l").distinct(), known, "l", "r", k=1, least=least)
    close = rest.join(like, "l").join(known, "r").select("name", "fighter_id", F.lit("fuzzy").alias("method"), (F.col("score") / 100.0).alias("confidence"))
    return first.union(close)


def newest_features(features: DataFrame, fights: DataFrame) -> DataFrame:
    """fighter_id and x, the array of ``FEATURES`` of the fighter's latest fight; what is missing or no number counts as 0.

    features: fight_id, fighter_id and payload_json; fights: fight_id and fight_date.
    """
    dated = features.join(fights.select("fight_id", "fight_date"), "fight_id", "left")
    newest = dated.groupBy("fighter_id").agg(F.max_by("payload_json", F.struct("fight_date", "fight_id")).alias("json"))
    m = F.col("m")
    flag = lambda c: F.when(F.lower(c).isin("", "0", "0.0", "false", "null"), 0.0).when(c.isNotNull(), 1.0)
    number = lambda c: F.nanvl(c.try_cast("double"), F.lit(0.0))
    values = [F.coalesce((flag if f.startswith("is_") else number)(F.get(F.array(F.element_at(m, f)), F.lit(0))), F.lit(0.0)) for f in FEATURES]
    return newest.select(F.col("fighter_id").cast("string").alias("fighter_id"), payload(F.col("json")).alias("m")).select("fighter_id", F.array(*values).alias("x"))


def _chance(model: tuple[dict[str, float], float], bounds: tuple[float, float]) -> Column:
    weights, bias = model
    diff = F.zip_with("__x__", "__y__", lambda a, b: a - b)
    return D.clamp(D.logit(diff, F.array(*[F.lit(float(weights.get(f"diff_{f}", 0.0))) for f in FEATURES]), F.lit(float(bias))), *bounds)


def projected(players: DataFrame, fighters: DataFrame, aliases: DataFrame, features: DataFrame, fights: DataFrame, win: tuple[dict[str, float], float] | None, finish: tuple[dict[str, float], float] | None) -> DataFrame:
    """The players with their opponent, both ids, the chances, the pace and a note on how they came about.

    A model is the weights of the differences (``diff_`` and the feature) and the bias. Every row stays: a player
    or opponent that no name resolves, or a missing model, gives the chances and the pace of an unknown side.
    """
    rows = with_opponents(players)
    asked = players.select(F.col("player_name").alias("name")).union(rows.select("opponent_name"))
    who, x = written(resolved(asked, fighters, aliases), "projection-who"), written(newest_features(features, fights), "projection-features")
    zeros = F.array(*[F.lit(0.0)] * len(FEATURES))
    for name, out, how, values in (("player_name", "fighter_id", "__f__", "__x__"), ("opponent_name", "opponent_id", "__o__", "__y__")):
        note = F.format_string("%s:%.2f", "method", "confidence")
        rows = rows.join(who.select(F.col("name").alias(name), F.col("fighter_id").alias(out), note.alias(how)), name, "left")
        rows = rows.join(x.select(F.col("fighter_id").alias(out), F.col("x").alias(values)), out, "left").withColumns({values: F.coalesce(values, zeros), how: F.coalesce(how, F.lit("none:0.00"))})

    known = F.col("fighter_id").isNotNull() & F.col("opponent_id").isNotNull()
    ok = known & F.lit(win is not None and finish is not None)
    either = lambda c, other: F.when(ok, c).otherwise(F.lit(other))
    p_win = _chance(win, WIN_BOUNDS) if win is not None else F.lit(None).cast("double")
    p_finish = _chance(finish, FINISH_BOUNDS) if finish is not None else F.lit(None).cast("double")
    sides = F.concat(F.lit("f="), "__f__", F.lit(" o="), "__o__")
    pace = {f"pace_{rate}_pm": either(D.clamp(F.col("__x__")[FEATURES.index(f"pre_last3_{rate}_pm")], low, high), usual) for rate, (low, high, usual) in PACE.items()}
    out = rows.withColumns(
        {
            "p_win": either(p_win, UNKNOWN["p_win"]),
            "p_finish_given_win": either(p_finish, UNKNOWN["p_finish_given_win"]),
            **pace,
            "is_5_round": ok & (F.col("__x__")[FEATURES.index("is_5_round")] > 0),
            "edge_note": F.when(ok, F.concat(F.lit("model_ok "), sides)).when(known, F.lit("model_missing")).otherwise(F.concat(F.lit("missing_fighter_match "), sides)),
        }
    ).withColumn("finish_equity", either(F.col("p_win") * F.col("p_finish_given_win"), UNKNOWN["finish_equity"]))
    new = ["fighter_id", "opponent_id", *UNKNOWN, *pace, "is_5_round", "edge_note"]
    return out.select(*[c for c in players.columns if c not in new], *new)


def scaled(projections: DataFrame) -> DataFrame:
    """Adds the optimizer's figures, rounded, from proj_points, floor, ceiling and stdev, gated by p_win where a model was used.

    Without points the projection is the fallback from salary and avg_points, and the optimizer's figures are null.
    """
    gate, used = D.gates(F.col("p_win")), F.startswith("edge_note", F.lit("model_ok"))
    gated = {c: F.when(used, F.col(c) * gate[g]).otherwise(F.col(c)) for c, g in (("proj_points", "mean"), ("floor", "floor"), ("ceiling", "ceiling"), ("stdev", "stdev"))}
    rows = projections.withColumns(gated)
    made = D.standardized(F.col("proj_points"), F.col("floor"), F.col("ceiling"), F.col("stdev"), F.col("salary"))
    digits = {"proj_mean": 2, "proj_floor": 2, "proj_ceiling": 2, "value": 4, "risk": 4}
    rows = rows.withColumn("__made__", made)
    has = F.col("proj_points").isNotNull()
    figures = {c: F.when(has, F.round(F.col(f"__made__.{c}"), n)) for c, n in digits.items()}
    return rows.withColumns(
        {
            **figures,
            "value_per_1k": F.when(F.col("salary") > 0, F.col("proj_points") / F.col("salary") * 1000.0).otherwise(0.0),
            "fight_volatility": F.col("stdev") / F.greatest(F.lit(1.0), F.col("proj_points")),
            "proj": F.coalesce("proj_points", D.fallback_projection(F.col("salary"), F.col("avg_points"))),
        }
    ).drop("__made__")
