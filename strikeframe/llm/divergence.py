"""Source divergence audit: how far the vocabularies of a language's sources lie from each other and from the language.

Plain relational: texts become terms by splitting at what no term holds, terms are counted by language and source,
the terms in enough texts of a language are its vocabulary, and every source gets a count, zeros included, for each
kept term. Counts become smoothed shares in whole numbers; sources of a language are compared term by term and the
differences summed, and each source's own terms are ranked by how much more it uses them than its language does.

Groups and vocabulary are crossed in ``salts`` parts of the vocabulary, so that no task has a language to itself;
the comparison runs by language and term, so a source with a third of all texts is no larger there than any other.
Each pair of sources is compared once and shown from both sides.

Defined results: null text, lang and source count as ''; repeated rows and rows of one id count each; a long text
counts whole; a source without kept terms has even shares; a language without vocabulary has differences of 0; ties
go to the smaller item by UTF-8; empty tables give empty tables; other columns are ignored, whatever their names.
Shares are exact as long as a count stays below 10^19.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikeframe.llm.common import discard, written

UPPER = "".join(map(chr, range(0x41, 0x5B)))
#: ASCII characters that no term holds, but for NUL, which ``translate`` would take for "delete".
BETWEEN = "".join(map(chr, [*range(0x01, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
SCALE = 1_000_000_000
SMOOTHING = 5


def terms(text: Column) -> Column:
    """The text's terms in order, A-Z lower-cased; empty strings stand between neighbouring separators."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), UPPER + BETWEEN, UPPER.lower() + " " * len(BETWEEN)), "[ \\x00]")


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences) and df (texts that hold it)."""
    rows = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"), terms(F.col(text)).alias("all"))
    # the array of a text's terms and that of its distinct ones go through the same exchange
    both = rows.select("lang", "source", F.posexplode(F.array("all", F.array_distinct("all"))).alias("distinct", "some"))
    each = both.select("lang", "source", "distinct", F.explode("some").alias("term")).where("term <> ''")
    return each.groupBy("lang", "source", "term").agg(F.count_if(F.col("distinct") == 0).alias("n"), F.sum("distinct").alias("df"))


def vocabulary(counted: DataFrame, least: int) -> DataFrame:
    """lang and term of the terms in at least ``least`` texts of the language."""
    return counted.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("of_lang")).where(F.col("df") >= least).drop("df")


def share(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTHING) / (total + SMOOTHING * size)), exactly."""
    top = (n + SMOOTHING).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, (total + SMOOTHING * size).cast("decimal(20,0)"))


def shares(docs: DataFrame, least: int = 30, salts: int | None = None, text: str = "text", lang: str = "lang", source: str = "source", scratch: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The groups (lang, source) and, for each group and kept term, n, p (the group's share) and q (the language's).

    The second frame is read from tables whose paths are added to ``scratch``.
    """
    spark = docs.sparkSession
    salts = salts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source")).distinct()
    groups = written(groups, "divergence-groups")
    counted = written(counts(docs, text, lang, source), "divergence-counts", scratch)
    kept = written(vocabulary(counted, least), "divergence-vocabulary", scratch)
    known = counted.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "of_lang")
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("size"), F.sum("of_lang").alias("lang_total"))
    totals = known.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sized = groups.join(of_lang, "lang").join(totals, ["lang", "source"], "left").fillna(0, ["total"])
    salted = sized.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    crossed = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")
    dense = crossed.join(known.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left").fillna(0, ["n"])
    return groups, dense.select(
        "lang", "source", "term", "n", share(F.col("n"), F.col("total"), F.col("size")).alias("p"), share(F.col("of_lang"), F.col("lang_total"), F.col("size")).alias("q")
    )


def between(groups: DataFrame, dense: DataFrame) -> DataFrame:
    """lang, source, item (another source of the lang) and value, the sum of their shares' differences."""
    a = dense.select("lang", "term", "source", "p")
    b = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p2"))
    gaps = a.join(b, ["lang", "term"]).where(F.col("source") < F.col("item"))
    gaps = gaps.groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("p2"))).alias("value"))
    others = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where(F.col("source") < F.col("item"))
    once = others.join(gaps, ["lang", "source", "item"], "left").fillna(0, ["value"])
    sides = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    return once.select("lang", "value", sides.alias("side")).select("lang", "side.source", "side.item", "value")


def audit(docs: DataFrame, least: int = 30, ranks: int = 50, salts: int | None = None, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank (see the module)."""
    used: list[str] = []
    groups, dense = shares(docs, least, salts, text, lang, source, used)
    dense = written(dense, "divergence-shares")
    discard(docs.sparkSession, used)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = between(groups, dense).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    own = dense.where((F.col("n") > 0) & (F.col("p") > F.col("q"))).select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    own = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    return pairs.unionByName(own.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
