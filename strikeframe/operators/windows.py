"""Window features: rolling and career averages without the current row, latest and first rows, interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikeframe.sources.scratch import written


def rolling_prior(df: DataFrame, by: list[str], order: list[Column | str], measures: list[str], spans: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """Averages of the last rows, and of all rows, before each row, and their number. One sort serves all frames."""
    base = Window.partitionBy(*by).orderBy(*order)
    career = base.rowsBetween(Window.unboundedPreceding, -1)
    new = {f"{m}_avg_{n}": F.avg(m).over(base.rowsBetween(-n, -1)) for m in measures for n in spans}
    new |= {f"{m}_avg_career": F.avg(m).over(career) for m in measures}
    return df.withColumns(new | {"prior_rows": F.count(F.lit(1)).over(career)})


def first_n(df: DataFrame, by: list[str], order: list[Column | str], n: int, out: str = "rn") -> DataFrame:
    """The first n rows of each group; Spark keeps no more of a group than that while sorting."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def sides(df: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """The first two rows of each group as sides A and B; more are dropped."""
    return first_n(df, by, order, 2, "__n__").withColumn("side", F.when(F.col("__n__") == 1, "A").otherwise("B")).drop("__n__")


def global_order(df: DataFrame, order: list[Column | str], out: str = "position") -> DataFrame:
    """Rows numbered in one order over the whole table, without a task that holds it all.

    Rows are dealt by ranges of all order columns, whatever their types, and sorted within their range; the ranges'
    counts give each one's first number. Rows that agree in all order columns are told apart by their place in the
    input, so that a value of half the table is dealt to many ranges, too. The dealt rows are written, since ranges
    come from a sample and would differ if they were drawn twice.
    """
    placed = dealt_in_order(df, order, [])
    counts = placed.groupBy("__part__").count()
    before = F.sum("count").over(Window.orderBy("__part__").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__part__", F.coalesce(before, F.lit(0)).alias("__before__"))
    # as many rows as there are ranges at most
    numbered = placed.join(F.broadcast(offsets), "__part__").withColumn(out, F.col("__before__") + F.col("__at__") + 1)
    return numbered.select(*(c for c in df.columns if c != out), out)


def dealt_in_order(df: DataFrame, order: list[Column | str], scratch: list[str]) -> DataFrame:
    """A table of the rows in parts of bounded size, each sorted and before the next, numbered by ``__part__`` and ``__at__``."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn("__tie__", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(parts, *keys, "__tie__").sortWithinPartitions(*keys, "__tie__").drop("__tie__")
    placed = written(dealt.withColumn("__at__", F.monotonically_increasing_id()), "order", scratch)
    return placed.withColumns({"__part__": F.shiftright("__at__", 33), "__at__": F.col("__at__").bitwiseAND((1 << 33) - 1)})


def rolling_prior_split(df: DataFrame, by: list[str], order: list[str], measures: list[str], spans: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """``rolling_prior`` for keys that may hold any part of the table.

    Rows are dealt in parts by key and order, so that a large key spans several parts and no task has it whole. Each
    part hands on, for the key that it ends with, the sums and counts of its rows and the last of them; what reaches a
    part's first key is added up over the parts before, of which there is one row each. Within a part the usual
    windows run, and what they lack at its beginning is taken from what was handed on.
    """
    most = max(spans)
    dealt = dealt_in_order(df, [*by, *order], [])
    row = F.struct(*[F.col(m).cast("double").alias(m) for m in measures])
    key = [F.col(b) for b in by]
    segment = Window.partitionBy("__part__", *by)
    placed = dealt.withColumn("__n__", F.row_number().over(segment.orderBy("__at__")))

    # one row a part: the key that it ends with, whether it began before, and what its rows of that key add up to
    ends = dealt.groupBy("__part__").agg(F.max("__at__").alias("__at__"))
    last = dealt.join(F.broadcast(ends), ["__part__", "__at__"]).select("__part__", *by)  # as many rows as parts, like all that follow
    same = [F.col(b).eqNullSafe(F.col(f"__k_{b}__")) for b in by]
    of_last = dealt.join(F.broadcast(last.select(F.col("__part__").alias("__p__"), *[F.col(b).alias(f"__k_{b}__") for b in by])), [F.col("__part__") == F.col("__p__"), *same])
    late = of_last.groupBy("__part__", *by).agg(
        F.count("*").alias("rows"), *[F.sum(F.col(m).cast("double")).alias(f"sum_{m}") for m in measures], *[F.count(m).alias(f"n_{m}") for m in measures]
    )
    tail = of_last.withColumn("__z__", F.row_number().over(Window.partitionBy("__part__").orderBy(F.desc("__at__")))).where(F.col("__z__") <= most)
    tail = tail.groupBy(F.col("__part__").alias("__p__")).agg(F.sort_array(F.collect_list(F.struct("__at__", row.alias("r")))).alias("tail"))
    handed = late.join(F.broadcast(tail), F.col("__part__") == F.col("__p__")).drop("__p__")
    before = Window.partitionBy(*by).orderBy("__part__").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    few = Window.partitionBy(*by).orderBy("__part__").rowsBetween(1 - most, Window.currentRow)
    carried = handed.select(
        (F.col("__part__") + 1).alias("__p__"), *[F.col(b).alias(f"__k_{b}__") for b in by], F.sum("rows").over(before).alias("__rows__"),
        *[F.sum(c).over(before).alias(f"__{c}__") for m in measures for c in (f"sum_{m}", f"n_{m}")], F.flatten(F.collect_list("tail").over(few)).alias("__tail__"),
    )
    # a part without rows hands nothing on, and no key goes past a part that it doesn't reach the end of
    rows = placed.join(F.broadcast(carried), [F.col("__part__") == F.col("__p__"), *same], "left")
    own = segment.orderBy("__at__")
    out = {}
    for m in measures:
        for n in spans:
            lacking = F.greatest(F.lit(0), F.least(n - F.col("__n__") + 1, F.when(F.col("__tail__").isNull(), 0).otherwise(F.size("__tail__"))))
            old = F.filter(_taken("__tail__", lacking, m), lambda v: v.isNotNull())
            total = F.coalesce(F.sum(F.col(m).cast("double")).over(own.rowsBetween(-n, -1)), F.lit(0.0)) + F.coalesce(F.aggregate(old, F.lit(0.0), lambda x, v: x + v), F.lit(0.0))
            count = F.count(m).over(own.rowsBetween(-n, -1)) + F.coalesce(F.size(old), F.lit(0))
            out[f"{m}_avg_{n}"] = F.when(count > 0, total / count)
        total = F.coalesce(F.sum(F.col(m).cast("double")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + F.coalesce(F.col(f"__sum_{m}__"), F.lit(0.0))
        count = F.count(m).over(own.rowsBetween(Window.unboundedPreceding, -1)) + F.coalesce(F.col(f"__n_{m}__"), F.lit(0))
        out[f"{m}_avg_career"] = F.when(count > 0, total / count)
    out["prior_rows"] = F.col("__n__") - 1 + F.coalesce("__rows__", F.lit(0))
    return rows.select(*df.columns, *[c.alias(n) for n, c in out.items()])


def _taken(rows: str, n: Column, measure: str) -> Column:
    """The measure of the last n of the rows handed on; empty without any."""
    last = F.slice(rows, F.greatest(F.size(rows) - n + 1, F.lit(1)), n)
    return F.when(F.coalesce(n, F.lit(0)) > 0, F.transform(last, lambda x: x["r"][measure])).otherwise(F.array().cast("array<double>"))


def gap_pick(df: DataFrame, by: list[str], score: str, tie: list[str], gap: float) -> DataFrame:
    """The best row of each group and whether it leads the second by the gap."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), *tie)
    ranked = df.withColumn("runner_up", F.lead(score).over(w)).withColumn("__n__", F.row_number().over(w)).where("__n__ = 1").drop("__n__")
    return ranked.withColumn("clear", F.col("runner_up").isNull() | (F.col(score) - F.col("runner_up") >= gap))


def interleave(df: DataFrame, bucket: str, order: list[Column | str], out: str = "turn") -> DataFrame:
    """Numbers rows within their bucket, so that (turn, bucket) orders them round-robin."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(bucket).orderBy(*order)))


def cyclic_slice(df: DataFrame, by: list[str], order: list[Column | str], start: int, n: int = 4) -> DataFrame:
    """n rows of each group from an offset on, around its end."""
    w = Window.partitionBy(*by)
    numbered = df.withColumn("__n__", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__all__", F.count("*").over(w))
    return numbered.where(F.pmod(F.col("__n__") - F.lit(start), F.col("__all__")) < n).drop("__n__", "__all__")


def share(df: DataFrame, by: list[str], column: str, out: str = "share") -> DataFrame:
    """A row's part of its group's sum; the sums are pre-aggregated and joined, so a large group is no one task's."""
    sums = df.groupBy(*[F.col(b).alias(f"__by_{b}__") for b in by]).agg(F.sum(column).alias("__sum__"))
    same = [F.col(b).eqNullSafe(F.col(f"__by_{b}__")) for b in by]  # rows without a key are a group, too
    return df.join(sums, same).drop(*[f"__by_{b}__" for b in by]).withColumn(out, F.col(column) / F.nullif(F.col("__sum__"), F.lit(0).cast(sums.schema["__sum__"].dataType))).drop("__sum__")


def ranked_strings(df: DataFrame, column: str, out: str = "position") -> DataFrame:
    """Distinct texts numbered in order."""
    return global_order(df.select(column).distinct(), [column], out)
