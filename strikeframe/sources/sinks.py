"""Table maintenance on plain files: each function makes the table's next state, which the caller writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeframe.sources.scratch import discard, written


def _last_of_each(df: DataFrame, keys: list[str], sequence: str | None) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    if sequence is None:  # no order is given: the largest row, so that the choice is always the same
        return df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__r__")).select(*keys, "__r__.*").select(*df.columns) if rest else df.distinct()
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), sequence).alias("__r__")).select(*keys, "__r__.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], sequence: str | None = None) -> DataFrame:
    """New rows replace old ones with their key; of several new ones the last by ``sequence``, or the largest."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(_last_of_each(new, keys, sequence))


def merge_partitions(spark: SparkSession, path: str, new: DataFrame, keys: list[str], partition: str, sequence: str | None = None) -> int:
    """``upsert`` into a table of files by a partition column, writing only partitions that change; returns how many.

    Changed are those that new rows belong to, and those that hold an old row of a new row's key, which may have moved.
    The others' files stay. A partition that loses its last row is deleted.
    """
    old = spark.read.parquet(path)
    new = _last_of_each(new.select(*old.columns), keys, sequence)
    scratch: list[str] = []
    new = written(new, "merge-new", scratch)
    held = old.select(*keys, partition).join(new.select(*keys), keys, "left_semi").select(partition)
    touched = written(held.union(new.select(partition)).distinct(), "merge-partitions", scratch)
    kept = old.join(touched, old[partition].eqNullSafe(touched[partition]), "left_semi").join(new.select(*keys), keys, "left_anti")
    merged = written(kept.unionByName(new), "merge-rows", scratch)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    n = touched.count()
    for r in touched.join(merged.select(partition).distinct(), touched[partition].eqNullSafe(merged[partition]), "left_anti").toLocalIterator():
        name = "__HIVE_DEFAULT_PARTITION__" if r[0] is None else str(r[0])
        discard(spark, [f"{path.rstrip('/')}/{partition}={name}"])
    discard(spark, scratch)
    return n


def upsert_columns(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str], sequence: str | None = None) -> DataFrame:
    """Each column by its rule: ``new`` (overwrite), ``fill`` (only where the old is null), ``prefer`` (the new unless
    it is null), ``keep``, as are columns without a rule. Rows of either side alone stay as they are; of several new rows
    of a key the last by ``sequence`` counts, or the largest."""
    rules = {c: "keep" for c in old.columns if c not in keys and c in new.columns} | rules
    alone = [c for c in old.columns if c not in keys and c not in rules]
    new = _last_of_each(new, keys, sequence)
    o = old.select(*keys, *[F.col(c).alias(f"__old_{c}__") for c in rules], *alone, F.lit(True).alias("__o__"))
    n = new.select(*keys, *[F.col(c).alias(f"__new_{c}__") for c in rules], F.lit(True).alias("__n__"))
    both = o.join(n, keys, "full_outer")

    def rule(c: str, how: str):
        a, b = F.col(f"__old_{c}__"), F.col(f"__new_{c}__")
        merged = {"new": b, "fill": F.coalesce(a, b), "prefer": F.coalesce(b, a), "keep": a}[how]
        return F.when(F.col("__n__").isNull(), a).when(F.col("__o__").isNull(), b).otherwise(merged).alias(c)

    return both.select(*keys, *[rule(c, how) for c, how in rules.items()], *alone)


def appended(old: DataFrame, new: DataFrame, ident: str, order: list[str]) -> DataFrame:
    """Old rows and new ones, which get the next ids in order; numbered without a task that holds them all."""
    from strikeframe.operators.windows import global_order

    last = old.agg(F.coalesce(F.max(ident), F.lit(0).cast("long"))).first()[0]
    numbered = global_order(new, order, ident).withColumn(ident, F.col(ident) + F.lit(last))
    return old.unionByName(numbered.select(*old.columns))


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and new ones whose key is not there."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def updated(df: DataFrame, source: DataFrame, key: str, columns: dict[str, str], default: object = None) -> DataFrame:
    """Columns taken from the source's row of the key (one row for a key), else the default, else as they were."""
    s = source.dropDuplicates([key]).select(key, *[F.col(c).alias(f"__{t}__") for t, c in columns.items()])
    other = lambda t: F.col(t) if default is None else F.lit(default)
    out = df.join(s, key, "left")
    return out.select(*[F.coalesce(f"__{c}__", other(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def work_done(queue: DataFrame, results: DataFrame, most_attempts: int) -> DataFrame:
    """The queue after some attempts: done, queued again, or error at the cap. Results hold url and error (null: done)."""
    r = results.select("url", F.col("error").alias("__error__"), F.lit(True).alias("__tried__"))
    tried = F.coalesce("__tried__", F.lit(False))
    attempts = F.col("attempts") + tried.cast("int")
    status = F.when(~tried, F.col("status")).when(F.col("__error__").isNull(), "done").when(attempts >= most_attempts, "error").otherwise("queued")
    out = queue.join(r, "url", "left")
    new = {"status": status, "attempts": attempts, "last_error": F.when(tried, F.col("__error__")).otherwise(F.col("last_error"))}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in queue.columns])


def audit_entries(old: DataFrame, new: DataFrame, key: str, columns: list[str], actor: str, at: Column) -> DataFrame:
    """An entry for each column of a key that differs between two states of a table, rows that came or went included.

    A column's values are compared as text, nulls alike; entries are only ever appended, with ``append_log``.
    """
    def long(df: DataFrame, value: str) -> DataFrame:
        return df.unpivot([key], [F.col(c).cast("string").alias(c) for c in columns], "action", value)

    both = long(old, "old_value").join(long(new, "new_value"), [key, "action"], "full").where(~F.col("old_value").eqNullSafe(F.col("new_value")))
    return both.select(F.lit(actor).alias("actor"), F.col(key).alias("target"), "action", "old_value", "new_value", at.alias("created_at"))


def append_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)


def key_values(figures: DataFrame) -> DataFrame:
    """The columns of a frame of one row as rows of key and value, as build metadata is kept."""
    return figures.select([F.col(c).cast("string").alias(c) for c in figures.columns]).unpivot([], figures.columns, "key", "value")


def documents_of(df: DataFrame) -> DataFrame:
    """Rows as JSON texts, for a file of one document a line."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def document(df: DataFrame, order: list[str], at: Column) -> DataFrame:
    """The whole table as one JSON document with its count and time, for small exports: one task holds it."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*df.columns).alias("r")))), lambda x: x["r"])
    return df.agg(rows.alias("rows")).select(F.to_json(F.struct(F.size("rows").alias("count"), at.alias("generated_at"), "rows")).alias("value"))


def write_report(df: DataFrame, path: str, mark: bool = False) -> None:
    """A CSV report with a header, for spreadsheets with a byte order mark before it."""
    if mark:  # a mark can only stand before a name that is written without quotes
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.write.mode("overwrite").option("header", True).csv(path)
