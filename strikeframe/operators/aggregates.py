"""Aggregations: long to wide, cards, duplicates, percentiles, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statistics of a round, by the keys that they are reported under.
ROUND_PAIRS = {
    "sig": ["Significant Strikes", "Significant Strikes %"],
    "tot": ["Total Strikes", "Total Strikes %"],
    "td": ["Takedowns", "Takedowns %"],
    "head": ["Head"],
    "body": ["Body"],
    "leg": ["Leg"],
}
ROUND_PREFIXES = {"dist": "distance", "clinch": "clinch", "ground": "ground"}
ROUND_SCALARS = {"kd": "Knockdowns", "sub_att": "Submissions Attempted", "rev": "Reversals", "passes": "Passes"}


def pivot_sum(df: DataFrame, keys: list[str], name: str, value: str, columns: dict[str, object]) -> DataFrame:
    """A column for each name: the sum of its values, 0 where a group has none. One pass, no distinct names needed."""
    return df.groupBy(*keys).agg(*[F.sum(F.when(F.col(name) == v, F.col(value)).otherwise(0)).alias(c) for c, v in columns.items()])


def pivot_max(df: DataFrame, keys: list[str], columns: dict[str, tuple[Column, Column]]) -> DataFrame:
    """A column for each (test, value): the largest value where the test holds, null where it never does."""
    return df.groupBy(*keys).agg(*[F.max(F.when(test, value)).alias(c) for c, (test, value) in columns.items()])


def round_statistics(long: DataFrame, strict: bool = False) -> DataFrame:
    """The 23 measures of each fighter's round from its long table (stat_key, a_landed, a_attempted, a_value).

    Scalars that come as plain numbers count, too, unless ``strict``.
    """
    from strikeframe.functions.parse import clock_seconds, pair_attempted, pair_landed

    key = F.col("stat_key")
    landed = F.coalesce(F.col("a_landed"), pair_landed(F.col("a_value")).cast("double"))
    attempted = F.coalesce(F.col("a_attempted"), pair_attempted(F.col("a_value")).cast("double"))
    scalar = landed if strict else F.coalesce(landed, F.col("a_value").try_cast("double"))
    columns: dict[str, tuple[Column, Column]] = {}
    tests = {c: key.isin(*keys) for c, keys in ROUND_PAIRS.items()} | {c: F.lower(key).startswith(p) for c, p in ROUND_PREFIXES.items()}
    for c, test in tests.items():
        columns[f"{c}_landed"], columns[f"{c}_attempted"] = (test, landed), (test, attempted)
    columns |= {c: (key == k, scalar) for c, k in ROUND_SCALARS.items()}
    control = F.contains(F.lower(key), F.lit("control"))
    columns["ctrl_sec"] = (control, F.coalesce(F.col("a_landed"), clock_seconds(F.col("a_value")).cast("double")))
    return pivot_max(long, ["fight_url", "round", "ss_fighter", "fighter_id"], columns)


def career_card(fighters: DataFrame, fights: DataFrame, key: str, count_unmatched: bool = False) -> DataFrame:
    """Totals of each fighter. ``count_unmatched`` also counts the empty row of a fighter without fights as no contest."""
    joined = fighters.join(fights.withColumn("__fight__", F.lit(1)), key, "left")
    unknown = F.col("is_win").isNull() if count_unmatched else F.col("is_win").isNull() & F.col("__fight__").isNotNull()
    return joined.groupBy(key).agg(
        F.count("__fight__").alias("fights"),
        F.sum(F.when(F.col("is_win") == 1, 1).otherwise(0)).alias("wins"),
        F.sum(F.when(F.col("is_win") == 0, 1).otherwise(0)).alias("losses"),
        F.lit(0).alias("draws"),
        F.sum(unknown.cast("int")).alias("no_contests"),
        F.max("fight_date").alias("last_fight"),
    )


def record_text(wins: Column, losses: Column, draws: Column, no_contests: Column) -> Column:
    """``W-L``, ``W-L-D`` if there are draws, and the number of no contests."""
    drawn = F.when(draws > 0, F.concat(F.lit("-"), draws.cast("string"))).otherwise("")
    void = F.when(no_contests > 0, F.concat(F.lit(" ("), no_contests.cast("string"), F.lit(" NC)"))).otherwise("")
    return F.concat(wins.cast("string"), F.lit("-"), losses.cast("string"), drawn, void)


def duplicates(df: DataFrame, keys: list[str], listed: str) -> DataFrame:
    """Groups of more than one row, with the listed column's values in order."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.col(listed).cast("string"))), ",").alias("members")).where("n > 1")


def percentiles(df: DataFrame, keys: list[str], column: str, at: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Exact, interpolated percentiles of each group."""
    return df.groupBy(*keys).agg(F.percentile(column, list(at)).alias("p")).select(*keys, *[F.col("p")[i].alias(f"p{round(100 * a)}") for i, a in enumerate(at)])


def percentiles_by_rank(df: DataFrame, keys: list[str], column: str, at: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """``percentiles`` of groups of any size, with a bounded part of the table in each task.

    ``percentiles`` holds a group's distinct values in one buffer. Here rows are put in order of group and value, and
    the two rows next to each percentile's place are picked by their number.
    """
    from strikeframe.operators.windows import global_order

    rows = df.select(*keys, F.col(column).cast("double").alias("__v__")).where("__v__ is not null")
    placed = global_order(rows, [*keys, "__v__"], "__n__")
    # one row a group: its first number and its size
    groups = placed.groupBy(*[F.col(k).alias(f"__k_{k}__") for k in keys]).agg(F.min("__n__").alias("__first__"), F.count("*").alias("__size__"))
    wanted = groups.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("__size__") - 1) * F.lit(a)).alias("k")) for i, a in enumerate(at)])).alias("__w__"))
    low, high = F.floor("__w__.k"), F.ceil("__w__.k")
    wanted = wanted.select("*", F.explode(F.array_distinct(F.array(low, high))).alias("__at__")).withColumn("__n__", F.col("__first__") + F.col("__at__"))
    met = wanted.join(placed.select("__n__", "__v__"), "__n__")
    k, names = F.col("__w__.k"), [f"p{round(100 * a)}" for a in at]

    def between(i: int) -> Column:
        below, above, part = (F.max(F.when((F.col("__w__.i") == i) & test, v)) for test, v in ((F.col("__at__") == F.floor(k), F.col("__v__")), (F.col("__at__") == F.ceil(k), F.col("__v__")), (F.lit(True), k - F.floor(k))))
        return below + (above - below) * part

    out = met.groupBy(*[f"__k_{k}__" for k in keys]).agg(*[between(i).alias(n) for i, n in enumerate(names)])
    return out.select(*[F.col(f"__k_{k}__").alias(k) for k in keys], *names)


def pair_totals(landed: str, attempted: str, name: str) -> list[Column]:
    """Sum of a pair that is null only if all are null, its ``X of Y`` and its percentage."""
    a, b = F.sum(landed), F.sum(attempted)
    return [
        a.alias(f"{name}_landed"),
        b.alias(f"{name}_attempted"),
        F.concat(a.cast("string"), F.lit(" of "), b.cast("string")).alias(f"{name}_text"),
        F.when(b > 0, 100.0 * a / b).alias(f"{name}_pct"),
    ]


def keys_with_prefix(df: DataFrame, maps: str, prefix: str) -> DataFrame:
    """The keys (column k) of all maps that begin with the prefix, in order."""
    return df.select(F.explode(F.map_keys(maps)).alias("k")).where(F.col("k").startswith(prefix)).distinct().orderBy("k")


def population_summary(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Mean, 10th and 90th percentile and population deviation of each group's whole numbers, from exact sums."""
    n, total, squares = F.count(column), F.sum(F.col(column).cast("long")), F.sum(F.col(column).cast("long") * F.col(column).cast("long"))
    spread = F.sqrt((n * squares - total * total).cast("double") / (n * n).cast("double"))
    at = F.percentile(column, [0.1, 0.9])
    return df.groupBy(*keys).agg((total.cast("double") / n).alias("mean"), at[0].alias("p10"), at[1].alias("p90"), spread.alias("stdev"))


def best_of_each(df: DataFrame, keys: list[str], score: str, ties: list[str]) -> DataFrame:
    """The row of the greatest score of each key; ties go to the smaller of the further columns."""
    negative = [(-F.col(c)).alias(f"__{c}__") for c in ties]
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(score, *negative)).alias("__r__")).select(*keys, "__r__.*").select(*df.columns)


def match_counters(df: DataFrame, key: str) -> DataFrame:
    """Rows in all, in pairs, beyond a pair, and alone."""
    n = F.col("n")
    sizes = df.groupBy(key).agg(F.count("*").alias("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    return sizes.agg(total(n).alias("total"), total(F.when(n >= 2, 2).otherwise(0)).alias("ok"), total(F.when(n > 2, n - 2).otherwise(0)).alias("ambiguous"), total(F.when(n == 1, 1).otherwise(0)).alias("unmatched"))
