"""Wide to long, mirrored rows, nested groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_statistics(df: DataFrame, ids: list[str], measures: list[str]) -> DataFrame:
    """stat_key and value of each measure; nulls stay. One expand, not a union of scans."""
    return df.unpivot(ids, measures, "stat_key", "value")


def mirrored(df: DataFrame, common: list[str], a: dict[str, str | Column], b: dict[str, str | Column]) -> DataFrame:
    """Two rows of each row: its sides, by the same names."""
    side = lambda names: F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in names.items()])
    return df.select(*common, F.inline(F.array(side(a), side(b))))


def entries(df: DataFrame, maps: str, keep: list[str]) -> DataFrame:
    """A row of each entry of a map."""
    return df.select(*keep, F.explode(maps).alias("stat_key", "value"))


def nested(df: DataFrame, by: list[str], columns: list[str], order: str, out: str, descending: bool = True) -> DataFrame:
    """Each group's rows as an array of structs in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order])))
    return df.groupBy(*by).agg((F.reverse(rows) if descending else rows).alias(out))


def side_by_side(df: DataFrame, row: str, column: str, values: list[str], value: str) -> DataFrame:
    """A line for each row key and a column for each of the given column keys."""
    return df.groupBy(row).pivot(column, values).agg(F.first(value, ignorenulls=True))
