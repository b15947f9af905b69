"""Data-quality checks, each a frame; the report is one row."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strikeframe.functions.domain import repair_score
from strikeframe.operators.predicates import FIGHT_BOUNDS, ROUND_BOUNDS, suspicious
from strikeframe.sources.scratch import discard


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose key the parent lacks; a null key is no orphan."""
    return child.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def repaired_outcomes(pairs: DataFrame, fight: str = "fight_id") -> DataFrame:
    """Fights of two rows that aren't won by exactly one get the winner their statistics speak for; ties stay.

    The pair's values come from one aggregation joined back, so no window over a fight is needed.
    """
    scored = pairs.withColumn("__score__", repair_score(*[F.col(c) for c in ("kd", "sub_att", "td_landed", "sig_landed", "ctrl_sec")]))
    about = scored.groupBy(fight).agg(
        F.count("*").alias("__n__"),
        F.coalesce(F.sum("is_win"), F.lit(-1)).alias("__wins__"),
        F.count("is_win").alias("__known__"),
        F.max("__score__").alias("__best__"),
        F.min("__score__").alias("__worst__"),
    )
    wrong = (F.col("__n__") == 2) & ~((F.col("__known__") == 2) & (F.col("__wins__") == 1)) & (F.col("__best__") > F.col("__worst__"))
    fixed = F.when(wrong, (F.col("__score__") == F.col("__best__")).cast("int")).otherwise(F.col("is_win"))
    return scored.join(about, fight, "left").withColumn("is_win", fixed).select(*pairs.columns)


def ambiguous_names(names: DataFrame, norm: str, ident: str) -> DataFrame:
    return names.groupBy(norm).agg(F.countDistinct(ident).alias("n"), F.array_sort(F.collect_set(ident)).alias("ids")).where("n >= 2")


def verdict(report: DataFrame, unmapped_most: int = 500, share_most: float = 0.10) -> DataFrame:
    """Adds fail, warn or pass to rows of core_rows, missing_sides, orphans, unmapped and round_rows."""
    hard = (F.col("core_rows") == 0) | (F.col("missing_sides") > 0) | (F.col("orphans") > 0)
    soft = (F.col("unmapped") > unmapped_most) | ((F.col("round_rows") > 0) & (F.col("unmapped") > share_most * F.col("round_rows")))
    return report.withColumn("verdict", F.when(hard, "fail").when(soft, "warn").otherwise("pass"))


def constraints(df: DataFrame, key: list[str], checks: dict[str, Column], parents: dict[str, DataFrame]) -> DataFrame:
    """constraint and violations: rows whose key is null or repeated, rows that fail a check (null passes), orphans.

    ``parents`` has, for a column of the table, the table that must have its values under the same name.
    """
    named = " ".join(key)
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    keys = df.groupBy(*key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(missing | (F.col("n") > 1), F.col("n")).otherwise(0)), F.lit(0)).alias("violations"))
    out = keys.select(F.lit(f"key {named}").alias("constraint"), "violations")
    if checks:
        failed = df.agg(*[F.count_if(~c).alias(f"check {n}") for n, c in checks.items()])
        out = out.unionByName(failed.unpivot([], failed.columns, "constraint", "violations"))
    for column, parent in parents.items():
        lost = orphans(df.select(column), parent, column).agg(F.count("*").alias("violations"))
        out = out.unionByName(lost.select(F.lit(f"parent {column}").alias("constraint"), "violations"))
    return out


#: Numbers that can't be negative and pairs of landed and attempted, of a fight's statistics and of a round's.
FIGHT_NUMBERS = ["kd", "sig_landed", "sig_att", "total_landed", "total_att", "td_landed", "td_att", "sub_att", "rev", "ctrl_sec"]
FIGHT_PAIRS = [("sig_landed", "sig_att"), ("total_landed", "total_att"), ("td_landed", "td_att")]
ROUND_NUMBERS = ["sig_landed", "sig_attempted", "tot_landed", "tot_attempted", "td_landed", "td_attempted", "kd", "sub_att", "rev", "passes", "ctrl_sec"]
ROUND_PAIRS = [("sig_landed", "sig_attempted"), ("tot_landed", "tot_attempted"), ("td_landed", "td_attempted")]


def suspicious_fight() -> Column:
    return suspicious(FIGHT_NUMBERS, FIGHT_PAIRS, FIGHT_BOUNDS)


def suspicious_round() -> Column:
    return suspicious(ROUND_NUMBERS, ROUND_PAIRS, ROUND_BOUNDS)


class Refused(ValueError):
    """A table that failed its audit and was not published; ``report`` holds the figures."""

    def __init__(self, report: dict[str, object]):
        super().__init__(f"the audit failed: {report}")
        self.report = report


def audited_write(df: DataFrame, path: str, figures: dict[str, Column], hard: Callable[[dict], bool], partition_by: list[str] | None = None) -> dict[str, object]:
    """Writes the table and works out the figures, aggregates of its rows, in the same pass; returns them.

    The table is written aside and takes the place of the one at ``path`` only if ``hard`` doesn't hold of the figures;
    else nothing at ``path`` changes, and ``Refused`` is raised.
    """
    spark = df.sparkSession
    seen, aside = Observation(), f"{path.rstrip('/')}.audit-{uuid.uuid4().hex}"
    df.observe(seen, *[c.alias(n) for n, c in figures.items()]).write.partitionBy(*(partition_by or [])).parquet(aside)
    report = dict(seen.get)
    if hard(report):
        discard(spark, [aside])
        raise Refused(report)
    discard(spark, [path])
    moved, to = spark._jvm.org.apache.hadoop.fs.Path(aside), spark._jvm.org.apache.hadoop.fs.Path(path)
    if not moved.getFileSystem(spark._jsc.hadoopConfiguration()).rename(moved, to):
        raise OSError(f"{aside} couldn't be renamed to {path}")
    return report


def report_lines(report: DataFrame, samples: dict[str, tuple[DataFrame, list[str], int]] | None = None, title: str = "AUDIT") -> DataFrame:
    """section, position and line of a text report: the figures of a frame of one row, then some rows of each sample.

    A sample is a frame, its columns (which also order it) and how many rows to show; one without rows shows ``none``.
    """
    names = [c for c in report.columns if c != "verdict"]
    head = report.select(F.lit(0).alias("section"), F.posexplode(F.array(F.lit(title), *[F.format_string(f"  {n:<28} %s", F.col(n).cast("string")) for n in names], *([F.concat(F.lit("STATUS: "), F.upper("verdict"))] if "verdict" in report.columns else []))).alias("position", "line"))
    out = head
    for k, (name, (rows, columns, most)) in enumerate((samples or {}).items(), 1):
        shown = rows.select(*columns).orderBy(*columns).limit(most)
        line = F.concat(F.lit("  "), F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in columns]))
        listed = shown.agg(F.sort_array(F.collect_list(F.struct(*columns, line.alias("__line__")))).alias("rows"))  # ``most`` rows
        texts = F.when(F.size("rows") == 0, F.array(F.lit("  none"))).otherwise(F.transform("rows", lambda r: r["__line__"]))
        out = out.unionByName(listed.select(F.lit(k).alias("section"), F.posexplode(F.concat(F.array(F.lit(name)), texts)).alias("position", "line")))
    return out
