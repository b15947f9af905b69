"""Sorting, paging and leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[Column | str], limit: int, offset: int = 0, most: int = 500) -> DataFrame:
    """A page of a totally ordered table; bounds are checked."""
    if not 0 < limit <= most or offset < 0:
        raise ValueError(f"limit must be in 1..{most}, offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def leaders(df: DataFrame, ident: str, metrics: list[str], n: int = 10) -> DataFrame:
    """The best n of each metric, in one pass over the table; ties go to the smaller id."""
    long = df.unpivot([ident], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value").where("value is not null")
    w = Window.partitionBy("metric").orderBy(F.desc("value"), ident)
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def random_sample(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """n rows in the order of a seeded digest of their key: chance by the seed, but the same when a task is run again."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    return df.orderBy(digest, key).limit(n)


def sorted_by(df: DataFrame, column: str, ties: list[str], descending: bool = False) -> DataFrame:
    """Ordered by a column that the caller names: text in any case, numbers as such, nulls last."""
    if column not in df.columns:
        raise ValueError(f"unknown column {column!r}")
    c = F.lower(column) if df.schema[column].dataType.simpleString() == "string" else F.col(column)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), *ties)
