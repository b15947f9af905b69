"""Queries over the driver's tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strikeframe.functions import domain as D
from strikeframe.functions import parse as P
from strikeframe.functions import text as X
from strikeframe.operators import aggregates as A
from strikeframe.operators import audit, joins, predicates, reshape, topk, windows
from strikeframe.plans import lineups, model, slate
from strikeframe.sources import readers, sinks
from strikeframe.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


# Windows


@query("""
SELECT o_orderkey, o_custkey,
  avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS o_totalprice_avg_3,
  avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS o_totalprice_avg_5,
  avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS o_totalprice_avg_10,
  avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o_totalprice_avg_career,
  count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_rows
FROM (SELECT o_orderkey, o_custkey, o_orderdate, round(o_totalprice) AS o_totalprice FROM orders)""")
def rolling_prior_orders(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.round("o_totalprice").alias("o_totalprice"))
    return windows.rolling_prior(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_totalprice"]).drop("o_orderdate", "o_totalprice")


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS position FROM orders")
def global_order(spark, d):
    return windows.global_order(t(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "position")


@query("SELECT c_custkey, c_mktsegment, CAST(row_number() OVER (ORDER BY c_mktsegment DESC, c_name DESC, c_custkey) AS BIGINT) AS position FROM customer")
def global_order_text(spark, d):
    """An order by texts, falling, of few values and many."""
    order = [F.desc("c_mktsegment"), F.desc("c_name"), "c_custkey"]
    return windows.global_order(t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), order).select("c_custkey", "c_mktsegment", "position")


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '1998-01-01' WHEN o_orderkey % 7 > 0 THEN o_orderdate END AS day FROM orders)
SELECT o_orderkey, CAST(row_number() OVER (ORDER BY day NULLS FIRST, o_orderkey) AS BIGINT) AS position FROM r""")
def global_order_hot(spark, d):
    """An order in which half of the rows have one date and a fourteenth has none."""
    day = F.when(F.col("o_orderkey") % 2 == 0, F.lit("1998-01-01").cast("timestamp")).when(F.col("o_orderkey") % 7 > 0, F.col("o_orderdate").cast("timestamp"))
    return windows.global_order(t(spark, d, "orders").select("o_orderkey", day.alias("day")), ["day", "o_orderkey"]).select("o_orderkey", "position")


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def latest_per_key(spark, d):
    rows = t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return joins.latest(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).drop("o_orderdate")


@query("""SELECT o_custkey, count(*) AS n, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS finished, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 5 GROUP BY o_custkey""")
def last5_summary(spark, d):
    rows = windows.first_n(t(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 5)
    return rows.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("finished"), F.sum(money("o_totalprice")).alias("total"))


@query("""SELECT user_id, event_id, CASE WHEN n = 1 THEN 'A' ELSE 'B' END AS side FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 2""")
def first_two_sides(spark, d):
    return windows.sides(t(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "side")


@query("""SELECT p_brand, p_partkey, p_retailprice, runner_up, runner_up IS NULL OR p_retailprice - runner_up >= 5 AS clear
FROM (SELECT *, lead(p_retailprice) OVER w AS runner_up, row_number() OVER w AS n FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)) WHERE n = 1""")
def score_gap_pick(spark, d):
    return windows.gap_pick(t(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], "p_retailprice", ["p_partkey"], 5)


@query("SELECT event_id, event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS INTEGER) AS turn FROM events")
def interleave_feed(spark, d):
    return windows.interleave(t(spark, d, "events").select("event_id", "event_type", "ts"), "event_type", [F.desc("ts"), "event_id"]).drop("ts")


@query("""SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS n, count(*) OVER (PARTITION BY event_type) AS c FROM events) WHERE (n - 3 + c) % c < 4""")
def cyclic_slice(spark, d):
    return windows.cyclic_slice(t(spark, d, "events").select("event_type", "event_id"), ["event_type"], ["event_id"], 3)


@query("""SELECT s_suppkey, s_nationkey, CAST(s_suppkey AS DOUBLE) / nullif(sum(s_suppkey) OVER (PARTITION BY s_nationkey), 0) AS share FROM supplier""")
def share_of_total(spark, d):
    return windows.share(t(spark, d, "supplier").select("s_suppkey", "s_nationkey"), ["s_nationkey"], "s_suppkey").select("s_suppkey", "s_nationkey", "share")


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT a.user_id, a.event_id, a.value, b.value AS other_value FROM s a LEFT JOIN s b ON a.user_id = b.user_id AND b.n = 3 - a.n AND b.n <= 2 WHERE a.n <= 2""")
def opponent_value(spark, d):
    """The value of the other side of each pair."""
    sides = windows.sides(t(spark, d, "events").select("user_id", "event_id", "ts", "value"), ["user_id"], ["ts", "event_id"])
    w = Window.partitionBy("user_id").orderBy("side")
    other = F.coalesce(F.when(F.col("side") == "A", F.lead("value").over(w)), F.when(F.col("side") == "B", F.lag("value").over(w)))
    return sides.select("user_id", "event_id", "value", other.alias("other_value"))


# Aggregations and reshaping

_LINES = ", ".join(f"CAST(sum(CASE WHEN l_linenumber = {i} THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS line_{i}" for i in range(1, 5))


@query(f"SELECT l_orderkey, {_LINES} FROM lineitem GROUP BY l_orderkey")
def pivot_sum(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"))
    return A.pivot_sum(rows, ["l_orderkey"], "l_linenumber", "q", {f"line_{i}": i for i in range(1, 5)})


@query("""SELECT l_orderkey, max(CASE WHEN l_returnflag IN ('A', 'R') THEN l_quantity END) AS back, max(CASE WHEN l_returnflag LIKE 'N%' THEN l_quantity END) AS kept, max(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END) AS open_price FROM lineitem GROUP BY l_orderkey""")
def pivot_max(spark, d):
    q = F.col("l_quantity")
    columns = {"back": (F.col("l_returnflag").isin("A", "R"), q), "kept": (F.col("l_returnflag").startswith("N"), q), "open_price": (F.col("l_linestatus") == "O", F.col("l_extendedprice"))}
    return A.pivot_max(t(spark, d, "lineitem"), ["l_orderkey"], columns)


@query("""SELECT stat_key, CAST(sum(value) AS DECIMAL(28,2)) AS total, count(*) AS n FROM (
SELECT 'l_quantity' AS stat_key, CAST(l_quantity AS DECIMAL(18,2)) AS value FROM lineitem UNION ALL SELECT 'l_extendedprice', CAST(l_extendedprice AS DECIMAL(18,2)) FROM lineitem
UNION ALL SELECT 'l_discount', CAST(l_discount AS DECIMAL(18,2)) FROM lineitem UNION ALL SELECT 'l_tax', CAST(l_tax AS DECIMAL(18,2)) FROM lineitem) GROUP BY stat_key""")
def unpivot_totals(spark, d):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = t(spark, d, "lineitem").select("l_orderkey", *[money(c).alias(c) for c in names])
    return reshape.long_statistics(rows, ["l_orderkey"], names).groupBy("stat_key").agg(F.sum("value").alias("total"), F.count("*").alias("n"))


@query("""SELECT o_orderkey, 'size' AS stat_key, length(o_orderpriority) AS value FROM orders UNION ALL SELECT o_orderkey, 'urgent', CASE WHEN o_orderpriority LIKE '1%' THEN 1 END FROM orders""")
def unpivot_rows(spark, d):
    p = F.col("o_orderpriority")
    rows = t(spark, d, "orders").select("o_orderkey", F.length(p).cast("long").alias("size"), F.when(p.startswith("1"), 1).cast("long").alias("urgent"))
    return reshape.long_statistics(rows, ["o_orderkey"], ["size", "urgent"])


@query("""SELECT l_orderkey, l_partkey AS me, l_suppkey AS other, 1 AS first FROM lineitem UNION ALL SELECT l_orderkey, l_suppkey, l_partkey, 0 FROM lineitem""")
def mirror_pairs(spark, d):
    a, b = {"me": "l_partkey", "other": "l_suppkey", "first": F.lit(1)}, {"me": "l_suppkey", "other": "l_partkey", "first": F.lit(0)}
    return reshape.mirrored(t(spark, d, "lineitem"), ["l_orderkey"], a, b)


@query("""SELECT c_custkey, count(o_orderkey) AS fights, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS wins, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS losses, 0 AS draws,
CAST(sum(CASE WHEN o_orderkey IS NOT NULL AND o_orderstatus NOT IN ('F', 'O') THEN 1 ELSE 0 END) AS BIGINT) AS no_contests, max(o_orderdate) AS last_fight,
CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS VARCHAR) || '-' || CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS VARCHAR)
 || CASE WHEN sum(CASE WHEN o_orderkey IS NOT NULL AND o_orderstatus NOT IN ('F', 'O') THEN 1 ELSE 0 END) > 0 THEN ' (' || CAST(sum(CASE WHEN o_orderkey IS NOT NULL AND o_orderstatus NOT IN ('F', 'O') THEN 1 ELSE 0 END) AS VARCHAR) || ' NC)' ELSE '' END AS record
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def career_card(spark, d):
    fights = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).alias("is_win"), F.col("o_orderdate").alias("fight_date"))
    card = A.career_card(t(spark, d, "customer").select("c_custkey"), fights, "c_custkey")
    return card.withColumn("record", A.record_text(*[F.col(c) for c in ("wins", "losses", "draws", "no_contests")]))


@query("""SELECT n_regionkey, count(*) AS n, string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY CAST(n_nationkey AS VARCHAR)) AS members FROM nation GROUP BY n_regionkey HAVING count(*) > 1""")
def duplicate_groups(spark, d):
    return A.duplicates(t(spark, d, "nation"), ["n_regionkey"], "n_nationkey")


@query("""SELECT l_orderkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS open FROM lineitem GROUP BY l_orderkey
HAVING sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) >= 2 OR sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) >= 3""")
def conditional_having(spark, d):
    one = lambda test: F.sum(F.when(test, 1).otherwise(0))
    g = t(spark, d, "lineitem").groupBy("l_orderkey").agg(one(F.col("l_returnflag") == "R").alias("returned"), one(F.col("l_linestatus") == "O").alias("open"))
    return g.where("returned >= 2 or open >= 3")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type HAVING count(*) >= 2")
def frequency(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).where("n >= 2")


@query("SELECT count(*) AS n, count(DISTINCT l_orderkey) AS n_orders, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def scalar_counts(spark, d):
    return t(spark, d, "lineitem").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("n_orders"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("""SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS p25, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.75) AS p75, quantile_cont(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag""")
def percentile_summary(spark, d):
    return A.percentiles(t(spark, d, "lineitem"), ["l_returnflag"], "l_quantity")


@query("""WITH q AS (SELECT p_brand, quantile_cont(p_size, 0.25) AS a, quantile_cont(p_size, 0.5) AS b, quantile_cont(p_size, 0.75) AS c FROM part GROUP BY p_brand)
SELECT p_partkey, CASE WHEN p_size >= c THEN 'top' WHEN p_size >= b THEN 'upper' WHEN p_size >= a THEN 'lower' ELSE 'bottom' END AS tier FROM part JOIN q USING (p_brand)""")
def tiering(spark, d):
    part = t(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return part.join(A.percentiles(part, ["p_brand"], "p_size"), "p_brand").select("p_partkey", predicates.tier(F.col("p_size"), F.col("p25"), F.col("p50"), F.col("p75")).alias("tier"))


@query("""SELECT l_orderkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) END) AS BIGINT) AS sig_landed, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sig_attempted,
CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) END) AS VARCHAR) || ' of ' || CAST(sum(CAST(l_quantity AS BIGINT)) AS VARCHAR) AS sig_text,
CASE WHEN sum(CAST(l_quantity AS BIGINT)) > 0 THEN 100.0::DOUBLE * CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) END) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) END AS sig_pct FROM lineitem GROUP BY l_orderkey""")
def null_keeping_totals(spark, d):
    q = F.col("l_quantity").cast("long")
    rows = t(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", q).alias("a"), q.alias("b"))
    return rows.groupBy("l_orderkey").agg(*A.pair_totals("a", "b", "sig"))


@query("""SELECT n_regionkey, list(n_name ORDER BY n_name) AS nations FROM nation GROUP BY n_regionkey""")
def grouped_lists(spark, d):
    return t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("nations"))


# Joins


@query("""SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, coalesce(o.o_orderstatus, '?') AS status, c.c_name, n.n_name, r.r_name FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def star_left(spark, d):
    f, o, c, n, r = (t(spark, d, x) for x in ("lineitem", "orders", "customer", "nation", "region"))
    out = f.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    out = out.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("o_orderstatus", F.lit("?")).alias("status"), "c_name", "n_name", "r_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def orphans(spark, d):
    return audit.orphans(t(spark, d, "customer").select("c_custkey", "c_name"), t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') OR c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def pending(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return joins.any_missing(t(spark, d, "customer").select("c_custkey"), [o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'")], "c_custkey")


@query("""WITH a AS (SELECT n_nationkey AS k, n_regionkey AS v FROM nation WHERE n_nationkey < 20), b AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN n_regionkey + 1 ELSE n_regionkey END AS v FROM nation WHERE n_nationkey >= 5)
SELECT coalesce(a.k, b.k) AS k, a.v AS old, b.v AS new, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'scratched' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'active' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.k = b.k""")
def reconcile_status(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("v"))
    return joins.reconcile(n.where("k < 20"), n.where("k >= 5").withColumn("v", F.when(F.col("k") % 3 == 0, F.col("v") + 1).otherwise(F.col("v"))), "k", "v")


@query("""WITH r AS (SELECT s_nationkey AS k, s_suppkey FROM supplier), c AS (SELECT k, count(*) AS n FROM r GROUP BY k)
SELECT n_nationkey AS k, coalesce(c.n, 0) AS candidates, CASE WHEN c.n = 1 THEN r.s_suppkey END AS s_suppkey FROM nation LEFT JOIN c ON c.k = n_nationkey LEFT JOIN r ON r.k = n_nationkey AND c.n = 1""")
def unique_only(spark, d):
    right = t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey")
    return joins.unique_only(t(spark, d, "nation").select(F.col("n_nationkey").alias("k")), right, "k")


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 1000000 WHEN c_custkey % 3 = 0 THEN c_custkey + 2000000 END AS id, CASE WHEN c_custkey % 5 = 0 THEN 'alias' WHEN c_custkey % 3 = 0 THEN 'exact' ELSE 'none' END AS method,
CASE WHEN c_custkey % 5 = 0 THEN 1.0::DOUBLE WHEN c_custkey % 3 = 0 THEN 0.98::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM customer""")
def alias_priority(spark, d):
    k = t(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    alias, exact = k.where("k % 5 = 0").withColumn("id", F.col("k") + 1000000), k.where("k % 3 = 0").withColumn("id", F.col("k") + 2000000)
    return joins.priority_lookup(k, "k", [("alias", alias, 1.0), ("exact", exact, 0.98)])


@query("""SELECT a.l_orderkey, a.l_linenumber AS one, b.l_linenumber AS two, a.l_quantity - b.l_quantity AS more FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber""")
def pair_self_join(spark, d):
    """The pairs of lines of each order; an order has a few lines, as a fight has two sides."""
    one = t(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("one"), F.col("l_quantity").alias("q"))
    two = one.select("l_orderkey", F.col("one").alias("two"), F.col("q").alias("r"))
    return one.join(two, "l_orderkey").where("one < two").select("l_orderkey", "one", "two", (F.col("q") - F.col("r")).alias("more"))


@query("""SELECT e.event_id, e.user_id, (SELECT arg_max(p.value, struct_pack(a := p.ts, b := p.event_id)) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts < e.ts) AS last_value FROM events e WHERE e.event_type <> 'purchase'""")
def as_of_latest(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "event_type", "ts", "value")
    out = joins.as_of(e.where("event_type <> 'purchase'"), e.where("event_type = 'purchase'").select("user_id", "ts", "value"), "user_id", "ts", "ts", "value", "last_value")
    return out.select("event_id", "user_id", "last_value")


@query("""WITH f AS (SELECT n_name, unnest(list_distinct([replace(lower(n_name), '_', ' '), list_extract(string_split(lower(n_name), '_'), -1)])) AS form FROM nation), u AS (SELECT form, min(n_name) AS full_name FROM f GROUP BY form HAVING count(DISTINCT n_name) = 1)
SELECT s_suppkey, CAST(s_suppkey % 30 AS VARCHAR) AS token, full_name FROM supplier LEFT JOIN u ON u.form = CAST(s_suppkey % 30 AS VARCHAR)""")
def token_lookup(spark, d):
    """Nations by the last word of their names; some tokens name none."""
    tokens = t(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 30).cast("string").alias("token"))
    return joins.token_lookup(tokens, t(spark, d, "nation").select("n_name"), "token", "n_name").select("s_suppkey", "token", "full_name")


@query()
def fuzzy_top_k(spark, d):
    p = t(spark, d, "part").select("p_name").distinct()
    return joins.fuzzy_top_k(p.withColumnRenamed("p_name", "a"), p.withColumnRenamed("p_name", "b"), "a", "b", 3, 70.0)


# Table maintenance


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def upsert_full(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return sinks.upsert(o, o.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("new")), ["o_orderkey"])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE c_mktsegment END AS c_mktsegment, c_name FROM customer""")
def upsert_fill(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_name")
    old = c.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 2 == 1, F.col("c_mktsegment")))
    new = c.select("c_custkey", F.lit("x").alias("c_mktsegment"), F.lit("y").alias("c_name"))
    return sinks.upsert_columns(old, new, ["c_custkey"], {"c_mktsegment": "fill", "c_name": "keep"})


@query("""SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_nationkey, 'late' FROM nation WHERE n_nationkey >= 10""")
def insert_missing(spark, d):
    n = t(spark, d, "nation").select("n_nationkey", "n_name")
    return sinks.insert_missing(n.where("n_nationkey < 10"), n.withColumn("n_name", F.lit("late")), ["n_nationkey"])


@query("""SELECT c_custkey, coalesce((SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey), 0) AS newest FROM customer""")
def correlated_update(spark, d):
    source = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("k"))
    return sinks.updated(t(spark, d, "customer").select("c_custkey", F.lit(None).cast("long").alias("newest")), source, "c_custkey", {"newest": "k"}, 0)


# Sorts and search


@query("""SELECT metric, p_partkey, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, p_partkey) AS rank FROM (
SELECT 'p_size' AS metric, p_partkey, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT 'p_retailprice', p_partkey, p_retailprice FROM part)) WHERE rank <= 10""")
def leaders(spark, d):
    return topk.leaders(t(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"])


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def paged(spark, d):
    return topk.page(t(spark, d, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), "o_orderkey"], 50, 100)


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') OR contains(lower(p_type), 'steel')")
def multi_search(spark, d):
    return t(spark, d, "part").where(predicates.contains_text(["p_name"], "a") | predicates.contains_text(["p_type"], "steel")).select("p_partkey", "p_name")


# Functions and rules


@query("""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9\\s''-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS norm, trim(regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9\\s]+', '', 'g'), '\\s+', ' ', 'g')) AS squeezed,
lower(regexp_replace(regexp_replace(p_name || ' (' || p_brand || ')', '[^0-9A-Za-z]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug, least(lower(p_name), lower(p_brand)) || ' vs ' || greatest(lower(p_name), lower(p_brand)) AS pair FROM part""")
def norm_names(spark, d):
    n, b = F.col("p_name"), F.col("p_brand")
    return t(spark, d, "part").select("p_partkey", X.norm_name(n).alias("norm"), X.squeeze_name(n).alias("squeezed"), X.slug(F.concat(n, F.lit(" ("), b, F.lit(")"))).alias("slug"), X.pair_key(n, b).alias("pair"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER) AS landed, CAST(l_quantity AS INTEGER) + l_linenumber AS attempted, CAST(l_quantity AS INTEGER) * 60 + l_linenumber AS seconds,
CAST(l_quantity AS INTEGER) || ':0' || l_linenumber AS clock, (l_linenumber - 1) * 300 + CAST(l_quantity AS INTEGER) * 60 + l_linenumber AS fight_seconds FROM lineitem""")
def parse_values(spark, d):
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber").cast("int")
    text, time = F.concat(q, F.lit(" of "), q + n), F.concat(q, F.lit(":0"), n)
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("x"), time.alias("y"))
    pair, seconds = P.pair(F.col("x")), P.clock_seconds(F.col("y"))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", pair["landed"].alias("landed"), pair["attempted"].alias("attempted"), seconds.alias("seconds"), P.clock(seconds).alias("clock"),
        P.fight_seconds(F.col("l_linenumber").cast("string"), F.col("y")).alias("fight_seconds"),
    )


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_payload(spark, d):
    return t(spark, d, "events").select("event_id", F.element_at(P.payload(F.col("props")), "k").try_cast("int").alias("k"))


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<style.*?</style>', ' ', 'g'), '(?is)<script.*?</script>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS bare FROM pages""")
def strip_html(spark, d):
    return t(spark, d, "pages").select("page_id", X.strip_html(F.col("html")).alias("bare"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target FROM pages""")
def extract_links(spark, d):
    return t(spark, d, "pages").select("page_id", F.explode(X.links(F.col("html"))).alias("target"))


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, regexp_replace(regexp_replace(regexp_replace(url, '^http://', 'https://'), '#.*$', ''), '/+$', '') AS norm FROM pages""")
def url_parts(spark, d):
    u = F.col("url")
    return t(spark, d, "pages").select("page_id", X.url_host(u).alias("host"), X.url_path(u).alias("path"), X.norm_url(u).alias("norm"))


@query("""SELECT c_custkey, CASE WHEN m < 0 THEN -m / (100.0::DOUBLE - m) WHEN m > 0 THEN 100.0::DOUBLE / (100.0::DOUBLE + m) END AS implied, CASE WHEN h > 100 THEN round(h / 2.54::DOUBLE, 2) ELSE h END AS height, greatest(0.05::DOUBLE, least(0.95::DOUBLE, m / 500.0::DOUBLE)) AS clamped
FROM (SELECT c_custkey, CAST(CAST(c_custkey % 700 AS INTEGER) - 350 AS DOUBLE) AS m, CAST(60 + c_custkey % 130 AS DOUBLE) AS h FROM customer)""")
def odds_and_units(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 700 - 350).cast("double").alias("m"), (F.col("c_custkey") % 130 + 60).cast("double").alias("h"))
    return rows.select("c_custkey", D.implied_probability(F.col("m")).alias("implied"), D.inches(F.col("h")).alias("height"), D.clamp(F.col("m") / 500.0, 0.05, 0.95).alias("clamped"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity < 0 OR l_discount < 0 OR l_discount > l_quantity OR l_quantity > 45 OR l_extendedprice > 80000 AS suspicious FROM lineitem""")
def quality_rules(spark, d):
    test = predicates.suspicious(["l_quantity", "l_discount"], [("l_discount", "l_quantity")], {"l_quantity": 45, "l_extendedprice": 80000})
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", test.alias("suspicious"))


@query("""SELECT c_custkey, c_name IS NULL OR length(trim(c_name)) < 2 OR length(trim(c_name)) > 60 OR contains(lower(c_name), 'privacy policy') AS furniture, length(trim(c_name)) > 0 AND length(trim(c_mktsegment)) > 0 AS complete FROM customer""")
def garbage_filter(spark, d):
    return t(spark, d, "customer").select("c_custkey", X.is_furniture(F.col("c_name")).alias("furniture"), predicates.complete("c_name", "c_mktsegment").alias("complete"))


@query("""SELECT count(*) AS core_rows, CAST(sum(CASE WHEN o_custkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_sides, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orphans,
CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS unmapped, count(*) AS round_rows, CASE WHEN count(*) = 0 OR (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) > 0 THEN 'fail'
WHEN sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) > 500 OR sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) > 0.1 * count(*) THEN 'warn' ELSE 'pass' END AS verdict FROM orders""")
def audit_verdict(spark, d):
    o = t(spark, d, "orders")
    lost = audit.orphans(o.select("o_orderkey", F.col("o_custkey").alias("c_custkey")), t(spark, d, "customer"), "c_custkey")
    marked = o.join(lost.select("o_orderkey", F.lit(1).alias("lost")), "o_orderkey", "left")
    one = lambda test: F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0))
    report = marked.agg(
        F.count("*").alias("core_rows"), one(F.col("o_custkey").isNull()).alias("missing_sides"), one(F.col("lost") == 1).alias("orphans"), one(F.col("o_orderstatus") == "P").alias("unmapped"), F.count("*").alias("round_rows")
    )
    return audit.verdict(report)


# Slates, models


def _players(spark: SparkSession, d: str) -> DataFrame:
    """A slate of 26 players made of the first customers."""
    return _as_players(t(spark, d, "customer").orderBy("c_custkey").limit(26))


def _slates(spark: SparkSession, d: str) -> DataFrame:
    """All customers as players, in slates of 26 by key."""
    return _as_players(t(spark, d, "customer")).withColumn("slate_id", F.floor(F.col("player_id").cast("long") / 26))


def _as_players(s: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    mean = 40.0 + k % 17 * 3
    return s.select(
        F.when(k < 1_000_000, F.lpad(k.cast("string"), 6, "0")).otherwise(k.cast("string")).alias("player_id"), F.col("c_name").alias("player_name"), F.concat(F.lit("f"), F.floor(k / 2).cast("string")).alias("fight_id"), (6700 + k % 15 * 200).cast("int").alias("salary"),
        mean.alias("proj_mean"), (mean * 0.5).alias("proj_floor"), (mean * 1.6).alias("proj_ceiling"), (mean / 8.0).alias("value"), (0.2 + k % 7 * 0.05).alias("risk"), (0.3 + k % 5 * 0.1).alias("p_win"), (0.1 + k % 4 * 0.1).alias("finish_equity"),
        (5.0 + k % 9 * 4).alias("own_proj"),
    )


@query("""WITH s AS (SELECT c_custkey AS k FROM customer), p AS (SELECT CASE WHEN k < 1000000 THEN lpad(CAST(k AS VARCHAR), 6, '0') ELSE CAST(k AS VARCHAR) END AS player_id, k, 40.0::DOUBLE + k % 17 * 3 AS m FROM s)
SELECT player_id, m + 0.3::DOUBLE * (m * 1.6::DOUBLE) + 1.5::DOUBLE * (m / 8.0::DOUBLE) + 14.0::DOUBLE * (0.3::DOUBLE + k % 5 * 0.1::DOUBLE) + 22.0::DOUBLE * (0.1::DOUBLE + k % 4 * 0.1::DOUBLE) + 0.0::DOUBLE - 12.0::DOUBLE * (0.2::DOUBLE + k % 7 * 0.05::DOUBLE) AS score FROM p""")
def player_scores(spark, d):
    return _as_players(t(spark, d, "customer")).select("player_id", D.player_score("gpp").alias("score"))


@query()
def optimized_lineups(spark, d):
    """The lineups of all customers, in slates of 26 by key."""
    return lineups.optimized(_slates(spark, d), "slate_id")


@query()
def lineup_exposures(spark, d):
    """How often each player of a slate is in its lineups, when any two of them differ by two players."""
    return lineups.exposures(lineups.optimized(_slates(spark, d), "slate_id", mode="cash", min_unique=2, max_exposure=0.5))


@query()
def trained_model(spark, d):
    """A logit of open orders by price and customer, fitted to all rows until its steps vanish."""
    o = t(spark, d, "orders").select(F.array(F.col("o_totalprice") / 100000.0, (F.col("o_custkey") % 10).cast("double")).alias("x"), (F.col("o_orderstatus") == "O").cast("double").alias("y"))
    w, b = model.train_logit(o, 2)
    return spark.createDataFrame([(w[0], w[1], b)], "w0 double, w1 double, b double")


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_orderpriority")
def work_queue(spark, d):
    queue = t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("url"), F.col("o_orderdate").alias("discovered_at"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("status"), F.lit(0).alias("attempts"), "o_orderpriority")
    return readers.next_work(queue, 3).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


# Event time


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_windows(spark, d):
    return streams.tumbling(t(spark, d, "events"), "1 hour").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark, d):
    out = streams.sessions(t(spark, d, "events"), "1 hour")
    return out.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")], "n")
