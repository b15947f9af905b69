"""Row tests made from configurations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The largest plausible totals of a fight and of a round.
FIGHT_BOUNDS = {"ctrl_sec": 3600, "sig_att": 500, "total_att": 700, "td_att": 50}
ROUND_BOUNDS = {"ctrl_sec": 900, "sig_attempted": 200, "tot_attempted": 300, "td_attempted": 20}


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def suspicious(numbers: list[str], pairs: list[tuple[str, str]], bounds: dict[str, float]) -> Column:
    """A negative number, more landed than attempted, or a bound exceeded; nulls are never suspicious."""
    tests = [F.col(c) < 0 for c in numbers] + [F.col(a) > F.col(b) for a, b in pairs] + [F.col(c) > top for c, top in bounds.items()]
    return any_of([F.coalesce(t, F.lit(False)) for t in tests])


def complete(*columns: str) -> Column:
    """All columns are present and not blank."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.length(F.trim(F.col(c).cast("string"))) > 0) for c in columns])


def contains_text(columns: list[str], query: str | None) -> Column:
    """Any of the columns holds the text, in any case; an empty query holds for all."""
    if not (query or "").strip():
        return F.lit(True)
    return any_of([F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(query.strip().lower())), F.lit(False)) for c in columns])


def search(df: DataFrame, column: str, query: str, limit: int = 50) -> DataFrame:
    """Rows whose column holds the text; the column must be one of the frame's."""
    if column not in df.columns:
        raise ValueError(f"unknown column {column!r}")
    return df.where(contains_text([column], query)).limit(max(1, min(limit, 500)))


def tier(value: Column, p25: Column, p50: Column, p75: Column) -> Column:
    return F.when(value >= p75, "top").when(value >= p50, "upper").when(value >= p25, "lower").otherwise("bottom")


def flags(**tests: Column) -> Column:
    """The names of the tests that hold."""
    return F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())


def in_range(test: Column, column: str, low: float | None, high: float | None) -> Column:
    """The test, and the number between the bounds that are given."""
    if low is not None:
        test = test & (F.col(column) >= low)
    return test if high is None else test & (F.col(column) <= high)
