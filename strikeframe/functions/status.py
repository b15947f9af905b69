"""What a status page shows: labels, tones, payloads as lines, and a slate's summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The labels and tones of states; any other is the last.
LABELS = {"healthy": ("System Healthy", "good"), "broken": ("System Problem", "bad"), "stale": ("Refresh Recommended", "warn")}
OTHER = ("Attention Needed", "warn")
COUNTS = ["active_fights", "changed_fights", "missing_odds", "orphan_rows", "duplicate_rows"]
ITEMS_SHOWN = 8


def _told(state: Column, place: int) -> Column:
    out = None
    for name, told in LABELS.items():
        out = F.when(state == name, told[place]) if out is None else out.when(state == name, told[place])
    return out.otherwise(OTHER[place])


def _text(v: Column, path: str) -> Column:
    return F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))


def health_card(json: Column) -> Column:
    """state, label, tone, summary, ready and counts of a health report; what is missing has its default, and so has a broken one."""
    v = F.try_parse_json(json)
    state = F.coalesce(_text(v, "$.status"), F.lit("attention_needed"))
    counts = [F.coalesce(F.try_variant_get(v, f"$.counts.{c}", "long"), F.lit(0).cast("long")).alias(c) for c in COUNTS]
    return F.struct(
        state.alias("state"), _told(state, 0).alias("label"), _told(state, 1).alias("tone"), F.coalesce(_text(v, "$.summary"), F.lit("MMA health summary unavailable")).alias("summary"),
        F.coalesce(F.try_variant_get(v, "$.optimizer_ready", "boolean"), F.lit(False)).alias("ready"), F.struct(*counts).alias("counts"),
    )


def detail_lines(json: Column) -> Column:
    """A report's summary, message, counts, warnings and first items as lines, in this order."""
    v = F.try_parse_json(json)
    one = lambda path: F.when(_text(v, path).isNotNull(), F.array(_text(v, path))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    counts = F.coalesce(F.try_variant_get(v, "$.counts", "map<string,string>"), F.create_map().cast("map<string,string>"))
    count_lines = F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("null"))))
    warnings = F.transform(F.coalesce(F.try_variant_get(v, "$.warnings", "array<string>"), none), lambda w: F.concat(F.lit("warning: "), w))
    items = F.slice(F.coalesce(F.try_variant_get(v, "$.items", "array<variant>"), F.array().cast("array<variant>")), 1, ITEMS_SHOWN)

    def item(x: Column, i: Column) -> Column:
        named = F.coalesce(*[_text(x, f"$.{k}") for k in ("title", "name", "reason")])
        return F.when(F.startswith(F.schema_of_variant(x), F.lit("OBJECT<")), F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(named, F.to_json(x)))).otherwise(F.try_variant_get(x, "$", "string"))

    return F.concat(one("$.summary"), one("$.message"), count_lines, warnings, F.filter(F.transform(items, item), lambda x: x.isNotNull()))


def flag_map(flags: DataFrame, key: str = "key", value: str = "value_text") -> DataFrame:
    """A table of flags, one row for each key, as one map; nulls stay."""
    return flags.where(F.col(key).isNotNull()).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("flags"))


def clock_of_sum(seconds: Column) -> Column:
    """Seconds as m:ss; below zero as 0:00, null as null."""
    s = F.greatest(seconds.cast("long"), F.lit(0))
    return F.when(seconds.isNotNull(), F.format_string("%d:%02d", F.floor(s / 60).cast("long"), s % 60))
