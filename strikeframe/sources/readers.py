"""Sources: typed slates, feature payloads, JSON feeds, previews and schema discovery."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeframe.functions.parse import number, whole
from strikeframe.functions.text import candidate_id, norm_name
from strikeframe.sources.sinks import upsert

SLATE = T.StructType([T.StructField(c, T.StringType()) for c in ("Position", "Name + ID", "Name", "ID", "Roster Position", "Salary", "Game Info", "TeamAbbrev", "AvgPointsPerGame")])


def csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Texts by header; types are given, never guessed from the data."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def slate(spark: SparkSession, path: str, slate_id: str) -> DataFrame:
    """Players of a slate file with a whole salary, and the row as JSON."""
    raw = csv(spark, path, SLATE)
    return raw.select(
        F.lit(slate_id).alias("slate_id"),
        F.trim("ID").alias("player_id"),
        F.trim("Name").alias("player_name"),
        F.trim("Roster Position").alias("roster_position"),
        whole(F.col("Salary")).alias("salary"),
        number(F.col("AvgPointsPerGame"), F.lit(0.0)).alias("avg_points_per_game"),
        F.trim("Game Info").alias("game_info"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in raw.columns])).alias("raw_json"),
    ).where("salary is not null")


def minimal_slate(spark: SparkSession, path: str) -> DataFrame:
    """The players of a slate file with the game's text as their fight and their average as projection."""
    raw = csv(spark, path, SLATE)
    return raw.select(
        F.trim("ID").alias("player_id"), F.trim("Name").alias("player_name"), whole(F.col("Salary")).alias("salary"), F.trim("Game Info").alias("fight_id"), number(F.col("AvgPointsPerGame"), F.lit(0.0)).alias("proj")
    )


def slate_state(old: DataFrame, new: DataFrame) -> DataFrame:
    """A table of slates after a slate file: its players replace those of the same slate and id."""
    return upsert(old, new, ["slate_id", "player_id"])


def feature_payloads(df: DataFrame, ids: tuple[str, ...] = ("fight_id", "fighter_id")) -> DataFrame:
    """The ids and the whole row as JSON, without what is null or no number."""
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    values = [F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns]
    return df.select(*ids, F.to_json(F.struct(*values)).alias("payload_json"))


def alias_file(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """raw_name and fighter_id of an alias file, by the raw name and by the normal one, for ids that are known.

    A row without an id takes the one that opens its first candidate; a file without the two columns is refused.
    """
    raw = csv(spark, path)
    lacking = [c for c in ("raw_name", "fighter_id") if c not in raw.columns]
    if lacking:
        raise ValueError(f"{path} lacks {', '.join(lacking)}")
    ident = F.coalesce(F.nullif(F.trim("fighter_id"), F.lit("")), candidate_id(F.col("candidate_1")) if "candidate_1" in raw.columns else F.lit(None).cast("string"))
    rows = raw.select(F.trim("raw_name").alias("raw"), ident.alias("fighter_id")).where("raw <> ''")
    forms = rows.select(F.explode(F.array_distinct(F.array("raw", norm_name(F.col("raw"))))).alias("raw_name"), "fighter_id")
    return forms.join(known.select("fighter_id").distinct(), "fighter_id", "left_semi").select("raw_name", "fighter_id").distinct()


def feed(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    """A JSON array file's newest objects, 1 to 20; what is no object is left out, a missing or broken file is empty."""
    schema = "title string, url string, source string, published_at string, thumbnail_url string, description string"
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    items = text.select(F.explode(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")).alias("v"))
    rows = items.where(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT<"))).select(F.from_json(F.to_json("v"), schema).alias("r")).select("r.*")
    return rows.orderBy(F.desc(F.coalesce(F.try_to_timestamp("published_at"), F.lit("1970-01-01").cast("timestamp"))), "url").limit(max(1, min(limit, 20)))


def require_tables(spark: SparkSession, names: list[str]) -> None:
    missing = [n for n in names if not spark.catalog.tableExists(n)]
    if missing:
        raise ValueError(f"missing tables: {', '.join(missing)}")


def preview(spark: SparkSession, table: str, allowed: set[str], order: list[str], limit: int = 50, offset: int = 0) -> DataFrame:
    """Some rows of an allowed table, in a total order."""
    if table not in allowed:
        raise ValueError(f"table {table!r} is not open to previews")
    return spark.table(table).orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, 500)))


def catalog_listing(spark: SparkSession, allowed: set[str] | None = None, counts: bool = False) -> DataFrame:
    """Names of the tables and views that may be shown, in order, with their numbers of rows if asked for."""
    names = sorted(t.name for t in spark.catalog.listTables() if allowed is None or t.name in allowed)
    if not counts or not names:
        return spark.createDataFrame([(n,) for n in names], "name string")
    each = [spark.table(n).agg(F.lit(n).alias("name"), F.count("*").alias("rows")) for n in names]
    return reduce(DataFrame.unionByName, each).orderBy("name")


def typed_tables(spark: SparkSession, files: dict[str, tuple[str, str]], views: dict[str, str] | None = None) -> None:
    """CSV files, each with its schema, as tables that are written anew, and views under further names."""
    for name, (path, schema) in files.items():
        spark.read.option("header", True).schema(schema).csv(path).write.mode("overwrite").option("overwriteSchema", True).saveAsTable(name)
    for view, table in (views or {}).items():
        spark.table(table).createOrReplaceTempView(view)


def overridden(df: DataFrame, overrides: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns taken from the override of a key that occurs once there, where it has a value."""
    once = overrides.groupBy(key).agg(F.count("*").alias("__n__"), *[F.min(c).alias(f"__{c}__") for c in columns]).where("__n__ = 1").drop("__n__")
    out = df.join(once, key, "left")
    return out.select(*[F.coalesce(F.nullif(F.trim(F.col(f"__{c}__").cast("string")), F.lit("")), F.col(c).cast("string")).alias(c) if c in columns else F.col(c) for c in df.columns])


def lookup(df: DataFrame, column: str, value: object) -> DataFrame:
    """The one row of a key's value; an error if there is none."""
    found = df.where(F.col(column) == F.lit(value)).limit(1)
    if found.isEmpty():
        raise LookupError(f"no row with {column} = {value!r}")
    return found


def model_row(models: DataFrame, name: str) -> DataFrame:
    """A model's columns, weights and bias from its stored payload; an error if there is none."""
    m = F.from_json("payload_json", "feature_cols array<string>, w array<double>, b double, n long").alias("m")
    return lookup(models, "model_name", name).select("model_name", m).select("model_name", "m.*")


def discovered(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame | None:
    """The wanted columns, each under the first of its names that the table has; None if it lacks the first of them."""
    have = {c.lower(): c for c in df.columns}
    found = {out: next((have[n] for n in names if n in have), None) for out, names in wanted.items()}
    if found[next(iter(wanted))] is None:
        return None
    return df.select(*[(F.col(c) if c else F.lit(None).cast("string")).alias(out) for out, c in found.items()])


def next_work(queue: DataFrame, most_attempts: int, n: int | None = None) -> DataFrame:
    """Queued items below the attempts' cap, oldest first; all of them unless n is given."""
    rows = queue.where((F.col("status") == "queued") & (F.col("attempts") < most_attempts)).orderBy("discovered_at", "url")
    return rows if n is None else rows.limit(n)


def crawl_frontier(seeds: DataFrame, pages: DataFrame, rounds: int, most: int = 3000) -> DataFrame:
    """URLs that links reach within some rounds, new ones only in each, up to a cap by round and URL."""
    from strikeframe.functions.text import links, norm_url

    edges = pages.select(norm_url(F.col("url")).alias("url"), F.explode(links(F.col("html"))).alias("to")).select("url", norm_url(F.col("to")).alias("to")).distinct()
    seen = seeds.select(norm_url(F.col("url")).alias("url"), F.lit(0).alias("round")).distinct()
    for r in range(1, rounds + 1):
        new = seen.where(F.col("round") == r - 1).join(edges, "url").select(F.col("to").alias("url")).distinct()
        seen = seen.unionByName(new.join(seen.select("url"), "url", "left_anti").withColumn("round", F.lit(r)))
    return seen.orderBy("round", "url").limit(most)
