"""How figures are shown. All are built-in expressions; what is missing or no finite number gets a mark instead."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _shown(c: Column, text: Column, none: str) -> Column:
    finite = c.isNotNull() & ~F.isnan(c) & ~c.isin(float("inf"), float("-inf"))
    return F.when(finite, text).otherwise(F.lit(none))


def fixed(c: Column, digits: int = 2, none: str = "-") -> Column:
    """With so many digits behind the point."""
    v = c.try_cast("double")
    return _shown(v, F.format_string(f"%.{digits}f", v), none)


def percent_of(c: Column, digits: int = 1, none: str = "-") -> Column:
    """A share as a percentage."""
    v = c.try_cast("double")
    return _shown(v, F.concat(fixed(v * 100.0, digits), F.lit("%")), none)


def whole_units(c: Column, unit: str, none: str = "—") -> Column:
    """Rounded, halves up, with a unit such as lb or in."""
    v = c.try_cast("double")
    return _shown(v, F.format_string(f"%d {unit}", F.floor(v + 0.5)), none)


def local_time(c: Column, zone: str) -> Column:
    """ISO text of a UTC time as date and time of the zone; empty for anything else."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), c.try_cast("timestamp_ntz"))
    return F.coalesce(F.date_format(local, "M/d/yyyy, h:mm:ss a"), F.lit(""))
