"""JSON payloads as variants: their keys, their types, and matrices of typed figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def variant(json: Column) -> Column:
    """The payload of a JSON object; null for broken JSON, for other values and for none."""
    v = F.try_parse_json(json)
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT<")), v)


def figure(payload: Column, key: str) -> Column:
    """A key's number, or the number that its text holds; null if there is neither, or no finite one."""
    path = "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"
    number = F.coalesce(F.try_variant_get(payload, path, "double"), F.trim(F.try_variant_get(payload, path, "string")).try_cast("double"))
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def merged_schema(df: DataFrame, payload: str) -> str:
    """The type that holds all payloads, in one aggregation of bounded size."""
    return df.agg(F.schema_of_variant_agg(F.col(payload))).first()[0]


def keys_of(df: DataFrame, payload: str) -> DataFrame:
    """key, n (payloads that have it) and kind (the type that holds its values), for all payloads."""
    rows = df.select(payload).where(F.col(payload).isNotNull())
    each = rows.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(payload).outer())).select("key", "value")
    return each.groupBy("key").agg(F.count("*").alias("n"), F.schema_of_variant_agg("value").alias("kind"))


def feature_keys(df: DataFrame, payload: str, prefix: str, most: int = 10_000) -> list[str]:
    """The keys of all payloads that begin with the prefix, in order; a matrix can't have more columns than ``most``."""
    found = keys_of(df, payload).where(F.startswith("key", F.lit(prefix))).select("key").orderBy("key").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} keys begin with {prefix!r}")
    return [r.key for r in found]


def matrix(df: DataFrame, payload: str, keys: list[str], label: Column, keep: list[str] | None = None) -> DataFrame:
    """x (the keys' figures, in order) and y of the rows that have them all and a label of 0 or 1."""
    x = F.array(*[figure(F.col(payload), k) for k in keys]).cast("array<double>")
    rows = df.select(*(keep or []), x.alias("x"), F.when(label.isin(0, 1), label.cast("double")).alias("y"))
    return rows.where(F.col("y").isNotNull() & F.forall("x", lambda v: v.isNotNull()))
