"""Join shapes. Plain joins are left to Catalyst's statistics; nothing is broadcast by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n__", F.row_number().over(w)).where("__n__ = 1").drop("__n__")


def unique_only(df: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Joins ``right`` where exactly one of its rows has the key; ``candidates`` counts them."""
    counts = right.groupBy(key).agg(F.count("*").alias("candidates"))
    once = right.join(counts.where("candidates = 1").select(key), key, "left_semi")
    return df.join(counts, key, "left").join(once, key, "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))


def priority_lookup(df: DataFrame, key: str, stages: list[tuple[str, DataFrame, float]], ident: str = "id") -> DataFrame:
    """The id that the first of the stages knows for the key, with the stage's name and confidence.

    Each stage is (name, frame of key and id with one row for a key, confidence).
    """
    out, found = df, []
    for i, (name, stage, confidence) in enumerate(stages):
        out = out.join(stage.select(F.col(key), F.col(ident).alias(f"__{i}__")), key, "left")
        found.append(F.when(F.col(f"__{i}__").isNotNull(), F.struct(F.col(f"__{i}__").alias(ident), F.lit(name).alias("method"), F.lit(confidence).alias("confidence"))))
    best = F.coalesce(*found)
    return out.select(*df.columns, best[ident].alias(ident), F.coalesce(best["method"], F.lit("none")).alias("method"), F.coalesce(best["confidence"], F.lit(0.0)).alias("confidence"))


def reconcile(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Status of each key in two states of a table: active, changed, added or scratched."""
    a, b = left.select(key, F.col(value).alias("old")), right.select(key, F.col(value).alias("new"))
    both = a.withColumn("in_old", F.lit(True)).join(b.withColumn("in_new", F.lit(True)), key, "full_outer")
    status = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "scratched").when(F.col("old").eqNullSafe(F.col("new")), "active").otherwise("changed")
    return both.select(key, "old", "new", status.alias("status"))


def any_missing(df: DataFrame, rights: list[DataFrame], key: str) -> DataFrame:
    """Rows whose key is missing from any of the frames."""
    out = df
    for i, r in enumerate(rights):
        out = out.join(r.select(key).distinct().withColumn(f"__{i}__", F.lit(True)), key, "left")
    missing = F.lit(False)
    for i in range(len(rights)):
        missing = missing | F.col(f"__{i}__").isNull()
    return out.where(missing).select(*df.columns)


def as_of(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, value: str, out: str) -> DataFrame:
    """The latest right value before each left row's time: one sort of the union by key, no range join."""
    l = left.select("*", F.col(left_time).alias("__t__"), F.lit(0).alias("__side__"), F.lit(None).cast(right.schema[value].dataType).alias("__v__"))
    r = right.select(F.col(by), F.col(right_time).alias("__t__"), F.lit(1).alias("__side__"), F.col(value).alias("__v__"))
    w = Window.partitionBy(by).orderBy("__t__", "__side__").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = l.unionByName(r, allowMissingColumns=True)
    return both.withColumn(out, F.last("__v__", ignorenulls=True).over(w)).where("__side__ = 0").drop("__t__", "__side__", "__v__")


def token_lookup(tokens: DataFrame, names: DataFrame, token: str, name: str) -> DataFrame:
    """The full name that a token stands for, if exactly one: by whole name, last word or last two words.

    The forms of a name are its join keys, so this is an equi-join, not a test of every pair.
    """
    from strikeframe.functions.text import last_two, last_word, norm_name

    full = norm_name(F.col(name))
    forms = names.select(F.col(name), F.explode(F.array_distinct(F.array(full, last_word(full), last_two(full)))).alias("__form__"))
    found = forms.groupBy("__form__").agg(F.countDistinct(name).alias("__n__"), F.min(name).alias("full_name")).where("__n__ = 1").drop("__n__")
    return tokens.withColumn("__form__", norm_name(F.col(token))).join(found, "__form__", "left").drop("__form__")


#: Most letters of a key of ``similar_pairs``.
LETTERS_A_KEY = 3


def _combinations(items: Column, size: int) -> Column:
    """All ways to take ``size`` (1 to 3) of the items in their order, as texts."""
    rest = lambda i: F.slice(items, i + 2, F.greatest(F.size(items) - i - 1, F.lit(0)))
    if size == 1:
        return items
    if size == 2:
        return F.flatten(F.transform(items, lambda a, i: F.transform(rest(i), lambda b: F.concat_ws(",", a, b))))
    return F.flatten(F.transform(items, lambda a, i: F.flatten(F.transform(rest(i), lambda b, j: F.transform(rest(i + j + 1), lambda c: F.concat_ws(",", a, b, c))))))


def _lettered(names: DataFrame, often: DataFrame, least: float) -> DataFrame:
    """n (the name), size, prefix (its rarest letters, numbered by occurrence) and width, the letters of its keys.

    A name of so many letters shares at least ``need`` with any partner, so that two partners, ordered alike, share
    ``width`` letters even when each drops all but its first ``size - need + width``.
    """
    rank = F.transform("letters", lambda c: F.struct(F.coalesce(F.element_at("often", c), F.lit(0)).alias("n"), c.alias("c")))
    rows = names.crossJoin(often).select("n", F.transform(F.array_sort(rank), lambda x: x["c"]).alias("letters"))  # ``often`` is one row
    need = F.ceil(least / (200.0 - least) * F.size("letters") - 1e-9).cast("int")
    rows = rows.withColumns({"size": F.size("letters"), "width": F.least(F.greatest(need, F.lit(1)), F.lit(LETTERS_A_KEY)), "need": F.greatest(need, F.lit(1))})
    return rows.where("size > 0").withColumn("prefix", F.slice("letters", 1, F.greatest(F.least(F.col("size"), F.col("size") - F.col("need") + F.col("width")), F.lit(0))))


def _keyed(rows: DataFrame, name: str, mine: str, other: str) -> DataFrame:
    """A row for each key: the partner's width, and as many letters of the prefix as both widths allow."""
    several = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.least(F.col("width"), F.lit(w)).alias("taken")) for w in range(1, LETTERS_A_KEY + 1)]))
    told = rows.select(F.col("n").alias(name), F.col("size").alias(f"{name}_size"), F.col("prefix").alias(f"{name}_prefix"), "width", "need", several.alias("x"))
    prefix = F.col(f"{name}_prefix")
    short = F.slice(prefix, 1, F.greatest(F.least(F.size(prefix), F.col(f"{name}_size") - F.col("need") + F.col("x.taken")), F.lit(0)))
    keys = F.when(F.col("x.taken") == 1, _combinations(short, 1)).when(F.col("x.taken") == 2, _combinations(short, 2)).otherwise(_combinations(short, 3))
    return told.withColumn(f"{name}_prefix", short).select(name, f"{name}_size", f"{name}_prefix", F.col("width").alias(mine), F.col("x.w").alias(other), F.explode(keys).alias("key"))


#: Most ways to leave letters out of a name for which ``similar_pairs`` takes the rest of it as a key, and most letters left out.
MOST_SHORTENED, MOST_LEFT_OUT = 200, 2


def _common(a: Column, b: Column, least: float) -> Column:
    """The least length of a common subsequence of two texts of such lengths that reaches the score."""
    return F.ceil(least * (a + b) / 200.0 - 1e-9).cast("int")


def _shortens(a: Column, b: Column, least: float) -> Column:
    """Whether pairs of such lengths are met by what is left of both; the others are met by letters."""
    common = _common(a, b, least)

    def few(n: Column) -> Column:
        out = n - common
        return (out <= MOST_LEFT_OUT) & (F.when(out == 2, n * (n - 1) / 2).when(out == 1, n).otherwise(1) <= MOST_SHORTENED)

    return (common <= F.least(a, b)) & few(a) & few(b)


def _shortened(names: DataFrame, other: DataFrame, name: str, least: float) -> DataFrame:
    """A row for each key of a name: a hash of both lengths and of what is left of its sorted words, for each length that
    the other side has and that may reach the score."""
    from strikeframe.functions.text import sorted_tokens

    sizes = other.agg(F.collect_set("size").alias("sizes"))  # one row
    may = F.filter("sizes", lambda s: _shortens(F.col("size"), s, least))
    rows = names.crossJoin(sizes).select("n", "size", sorted_tokens(F.col("n")).alias("text"), F.explode(may).alias("partner"))
    without = lambda text, i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text)))
    places = lambda size: F.sequence(F.lit(1), size)
    text, size, out = F.col("text"), F.col("size"), F.col("size") - _common(F.col("size"), F.col("partner"), least)
    two = F.flatten(F.transform(F.filter(places(size), lambda i: i > 1), lambda i: F.transform(F.sequence(F.lit(1), i - 1), lambda j: without(without(text, i), j))))
    left = F.when(out == 0, F.array(text)).when(out == 1, F.transform(places(size), lambda i: without(text, i))).otherwise(two)
    lengths = ("size", "partner") if name == "ln" else ("partner", "size")
    return rows.select(F.col("n").alias(name), *lengths, F.explode(F.array_distinct(left)).alias("rest")).select(name, F.xxhash64(*lengths, "rest").alias("key"))


def similar_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """ln and rn: all pairs of different normal names (column n) that may reach the least token-sort ratio, once each.

    Two lengths and the score tell how many letters each name may lack of a common subsequence. Where these are few,
    what is left of a name without them is its key, which (but for chance hashes) only similar names share, so the keys
    grow with the names and the pairs with the similar ones. Other lengths are met by letters: a common subsequence is
    no longer than what two texts have of each letter. Those keys are up to three of a name's rarest letters, so a key
    is shared by few names however common its letters are alone; a pair is taken at the first key that both have, and
    only if its lengths allow the score.
    """
    from strikeframe.functions.text import sorted_letters, sorted_tokens

    a, b = (df.select("n").where("n <> ''").distinct().withColumn("letters", sorted_letters(F.col("n"))) for df in (left, right))
    sized = [df.select("n", F.length(sorted_tokens(F.col("n"))).alias("size")).where("size > 0") for df in (a, b)]
    near = _shortened(sized[0], sized[1], "ln", least).join(_shortened(sized[1], sized[0], "rn", least), "key").where(F.col("ln") != F.col("rn")).select("ln", "rn").distinct()
    return near.unionByName(_by_letters(*(_of_long(df, other, least) for df, other in ((a, sized[1]), (b, sized[0]))), b, least))


def _of_long(names: DataFrame, other: DataFrame, least: float) -> DataFrame:
    """The names that some length of the other side may be similar to, but not by what is left of both."""
    size = F.size("letters")
    sizes = other.agg(F.collect_set("size").alias("sizes"))  # one row
    rest = F.exists("sizes", lambda s: (_common(size, s, least) <= F.least(size, s)) & ~_shortens(size, s, least))
    return names.crossJoin(sizes).where(rest).select("n", "letters")


def _by_letters(a: DataFrame, b: DataFrame, every: DataFrame, least: float) -> DataFrame:
    """The pairs of ``similar_pairs`` that are not met by what is left of both; letters are as rare as in ``every``."""
    often = every.select(F.explode("letters").alias("c")).groupBy("c").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("often"))
    l, r = _keyed(_lettered(a, often, least), "ln", "wl", "wr"), _keyed(_lettered(b, often, least), "rn", "wr", "wl")
    pairs = l.join(r, ["key", "wl", "wr"]).where(F.col("ln") != F.col("rn"))
    pairs = pairs.where((200.0 * F.least("ln_size", "rn_size") >= least * (F.col("ln_size") + F.col("rn_size"))) & ~_shortens(F.col("ln_size"), F.col("rn_size"), least))
    both = F.array_intersect("ln_prefix", "rn_prefix")
    return pairs.where(F.array_join(F.slice(both, 1, F.least("wl", "wr")), ",") == F.col("key")).select("ln", "rn")


def fuzzy_top_k(left: DataFrame, right: DataFrame, left_name: str, right_name: str, k: int = 3, least: float = 70.0) -> DataFrame:
    """The k most similar right names of each left name, of all that reach the least score (above 0).

    Names that are equal when normalised are no pair. Candidates are those of ``similar_pairs``, less those whose
    letters can't reach the score.
    """
    from strikeframe.functions.text import letter_places, letter_rows, norm_name, sorted_letters, subsequence_of

    a, b = (df.select(F.col(c).alias(o), norm_name(F.col(c)).alias("n")) for df, c, o in ((left, left_name, "l"), (right, right_name, "r")))
    pairs = similar_pairs(a, b, least)
    detail = lambda df, n, more: df.select("n").distinct().select(F.col("n").alias(n), sorted_letters(F.col("n")).alias(f"{n}_letters"), *more)
    pairs = pairs.join(detail(a, "ln", [letter_rows(F.col("n")).alias("rows")]), "ln").join(detail(b, "rn", [letter_places(F.col("n")).alias("places")]), "rn")
    both = F.size("ln_letters") + F.size("rn_letters")
    pairs = pairs.where(200.0 * F.size(F.array_intersect("ln_letters", "rn_letters")) >= least * both)
    pairs = pairs.withColumn("score", 200.0 * subsequence_of(F.col("ln"), F.col("rn"), F.col("rows"), F.col("places")) / both).where(F.col("score") >= least)
    scored = pairs.select("ln", "rn", "score").join(a.withColumnRenamed("n", "ln"), "ln").join(b.withColumnRenamed("n", "rn"), "rn")
    w = Window.partitionBy("l").orderBy(F.desc("score"), "rn", "r")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("l", "r", "score", "rank")


def alias_candidates(left: DataFrame, right: DataFrame, query: str, name: str, k: int = 8, least: float | None = None) -> DataFrame:
    """Of each query the k best names of the same first word, by score, reason and name; never itself.

    Names that share a further word are met by first and further word, those that extend one another by their
    beginnings, and, if ``least`` is given, those of that token-sort ratio by ``similar_pairs``; of a pair met in
    several ways the best score counts, so no query is compared with every name of its first word. All names that
    extend a query score alike, so only the first k of each beginning are kept.
    """
    from strikeframe.functions.text import norm_name, tokens

    def parts(df: DataFrame, c: str, out: str) -> DataFrame:
        words = tokens(F.col(out))
        return df.select(F.col(c).alias(out)).distinct().select(out, F.get(words, F.lit(0)).alias("first"), F.array_distinct(F.slice(words, 2, 1_000_000)).alias("rest"), F.size(words).alias("size")).where("size > 0")

    q, n = parts(left, query, "q"), parts(right, name, "n")
    sharing = q.select("q", "first", F.explode("rest").alias("w")).join(n.select("n", "first", F.explode("rest").alias("w")), ["first", "w"]).where("q <> n")
    sharing = sharing.groupBy("q", "n").agg((95 + F.least(F.count("*"), F.lit(3))).cast("int").alias("score")).select("q", "n", "score", F.lit("same_first_plus_overlap").alias("reason"))
    begin = lambda df, c: df.select(c, F.explode(F.transform(F.filter(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(F.col(c), i, F.lit(1)) == " "), lambda i: F.substring(F.col(c), F.lit(1), i - 1))).alias("b"))
    order = Window.partitionBy("b").orderBy("n")
    first = begin(n, "n").withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    longer = q.select("q").join(first, F.col("q") == F.col("b")).select("q", "n", F.lit(97).alias("score"), F.lit("canonical_extends_query").alias("reason"))
    shorter = begin(q, "q").join(n.select("n"), F.col("n") == F.col("b")).select("q", "n", F.lit(94).alias("score"), F.lit("query_extends_canonical").alias("reason"))
    # a pair that shares a further word is not also one of those that extend one another
    extending = longer.unionByName(shorter).where("q <> n").join(sharing.select("q", "n"), ["q", "n"], "left_anti")
    every = sharing.unionByName(extending)
    if least is not None:
        like = fuzzy_top_k(q.select("q"), n.select("n"), "q", "n", k=1_000_000, least=least)
        same = F.substring_index(norm_name(F.col("l")), " ", 1) == F.substring_index(norm_name(F.col("r")), " ", 1)
        every = every.unionByName(like.where(same).select(F.col("l").alias("q"), F.col("r").alias("n"), F.floor("score").cast("int").alias("score"), F.lit("same_firstname_fuzzy").alias("reason")))
        every = every.groupBy("q", "n").agg(F.max_by("reason", F.struct("score", F.col("reason") != "same_firstname_fuzzy")).alias("reason"), F.max("score").alias("score")).select("q", "n", "score", "reason")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "reason", "n")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(query), F.col("n").alias(name), "score", "reason", "rank")
