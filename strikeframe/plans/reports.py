"""More queries over the driver's tables: cleaning, audits, status, sorting, slates' figures and fights' marts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from strikeframe.functions import display
from strikeframe.functions import domain as D
from strikeframe.functions import names as N
from strikeframe.functions import text as X
from strikeframe.operators import aggregates as A
from strikeframe.operators import joins, predicates, topk, windows
from strikeframe.plans import marts, projection, slate
from strikeframe.plans.registry import _as_players, query, t
from strikeframe.sources import readers, sinks

# Names, labels and pages


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE replace(lower(c_name), '#', ' ') END AS conformed,
CASE WHEN c_custkey % 7 = 0 THEN 'NBA Odds Calculator' ELSE c_name END AS label, c_custkey % 7 = 0 OR c_custkey % 5 = 0 AS bad FROM customer""")
def clean_names(spark, d):
    k, name = F.col("c_custkey"), F.col("c_name")
    raw = F.when(k % 7 == 0, "UFC stats NBA").when(k % 3 == 0, F.concat(F.lit("South Korea "), name)).when(k % 3 == 1, F.concat(F.lit("USA  "), name)).otherwise(name)
    label = F.when(k % 7 == 0, "USA NBA Odds Calculator").when(k % 3 == 0, F.concat(F.lit("New Zealand "), name)).when(k % 3 == 1, F.concat(F.lit("USA  "), name)).otherwise(name)
    bad = F.when(k % 7 == 0, "see odds  calculator").when(k % 5 == 0, "a b c d e f g").otherwise(name)
    shown = F.when(k % 7 == 0, F.regexp_replace(label, "^USA ", "USA  ")).otherwise(label)
    return t(spark, d, "customer").select("c_custkey", N.conformed_name(raw).alias("conformed"), N.label_name(shown).alias("label"), N.is_bad_name(bad).alias("bad"))


@query("""SELECT page_id, length(html) >= 1500 AND contains(lower(html), 'the') AND (contains(html, url) OR contains(lower(html), '<article')) AS checked FROM pages""")
def page_checks(spark, d):
    h = F.col("html")
    own = F.contains(h, F.col("url")) | h.rlike("(?i)<article")
    return t(spark, d, "pages").select("page_id", ((F.length(h) >= 1500) & h.rlike("(?i)the") & own).alias("checked"))


@query("""SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN o_orderstatus END, ''), o_orderpriority) AS filled FROM orders""")
def first_filled_text(spark, d):
    k = F.col("o_orderkey")
    return t(spark, d, "orders").select("o_orderkey", N.first_filled(F.when(k % 3 == 0, "  ").when(k % 3 == 1, F.col("o_orderstatus")), F.col("o_orderpriority")).alias("filled"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN 'A' || c_custkey END AS away, CASE WHEN c_custkey % 4 < 3 THEN 'B ' || c_nationkey END AS home FROM customer""")
def matchups(spark, d):
    k, a, b = F.col("c_custkey"), F.concat(F.lit("A"), F.col("c_custkey")), F.concat(F.lit("B "), F.col("c_nationkey"))
    text = F.when(k % 4 == 0, F.concat(a, F.lit("@"), b, F.lit(" 03/07/2026 06:00PM ET"))).when(k % 4 == 1, F.concat(a, F.lit(" @ "), b, F.lit(" (postponed)"))).when(k % 4 == 2, F.concat(a, F.lit(" vs. "), b)).otherwise(a)
    sides = N.matchup(text)
    return t(spark, d, "customer").select("c_custkey", sides["away"].alias("away"), sides["home"].alias("home"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Jo O''Neil-' || chr(CAST(65 + c_custkey % 26 AS INTEGER)) END AS winner, CAST((60 + c_custkey % 20) // 12 AS VARCHAR) || ''' ' || CAST((60 + c_custkey % 20) % 12 AS VARCHAR) || '"' AS height FROM customer""")
def winners_and_heights(spark, d):
    k = F.col("c_custkey")
    name = F.concat(F.lit("Jo O'Neil-"), F.chr(65 + k % 26))
    text = F.when(k % 2 == 0, F.concat(name, F.lit(" (Win) 1 Some Body (Loss)"))).otherwise(F.concat(name, F.lit(" (draw)")))
    return t(spark, d, "customer").select("c_custkey", N.winner(text).alias("winner"), N.feet_and_inches(60 + k % 20 + 0.4).alias("height"))


_ALIAS_SQL = """WITH n AS (SELECT DISTINCT p_name || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' ' || lower(p_type) END AS name FROM part), w AS (SELECT name, string_split(name, ' ') AS words FROM n),
p AS (SELECT q.name AS query, c.name AS name, len(list_intersect(list_distinct(q.words[2:]), list_distinct(c.words[2:]))) AS common FROM w q JOIN w c ON q.words[1] = c.words[1] AND q.name <> c.name),
s AS (SELECT query, name, CAST(CASE WHEN common > 0 THEN 95 + least(common, 3) WHEN starts_with(name, query || ' ') THEN 97 WHEN starts_with(query, name || ' ') THEN 94 END AS INTEGER) AS score,
 CASE WHEN common > 0 THEN 'same_first_plus_overlap' WHEN starts_with(name, query || ' ') THEN 'canonical_extends_query' WHEN starts_with(query, name || ' ') THEN 'query_extends_canonical' END AS reason FROM p),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, reason, name) AS INTEGER) AS rank FROM s WHERE score IS NOT NULL) SELECT query, name, score, reason, rank FROM r WHERE rank <= 8"""


@query(_ALIAS_SQL)
def alias_candidates(spark, d):
    """Of each name the best eight others with the same first word."""
    kind = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit(" "), F.lower("p_type")))
    names = t(spark, d, "part").select(F.concat("p_name", kind).alias("name")).distinct()
    return joins.alias_candidates(names.withColumnRenamed("name", "query"), names, "query", "name")


# Predicates and joins


@query("SELECT o_orderkey FROM orders WHERE length(trim(o_orderpriority)) > 0 AND CAST(substr(o_orderpriority, 1, 1) AS INTEGER) > 2")
def non_blank_rows(spark, d):
    return t(spark, d, "orders").where((F.length(F.trim("o_orderpriority")) > 0) & (F.substring("o_orderpriority", 1, 1).try_cast("int") > 2)).select("o_orderkey")


@query("SELECT p_partkey, p_retailprice FROM part WHERE (contains(lower(p_name), 'red') OR contains(lower(p_brand), '1')) AND p_retailprice BETWEEN 905 AND 1200")
def text_and_range(spark, d):
    return t(spark, d, "part").where(predicates.in_range(predicates.contains_text(["p_name", "p_brand"], " RED ") | predicates.contains_text(["p_brand"], "1"), "p_retailprice", 905, 1200)).select("p_partkey", "p_retailprice")


@query("SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_suppkey")
def valid_keys(spark, d):
    known = t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t(spark, d, "lineitem").join(known, "l_orderkey", "left_semi").groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name, coalesce(n_name, '-') AS n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(c_name), '77') OR contains(lower(n_name), 'nation_3') OR contains(lower(c_mktsegment), 'house')")
def profile_search(spark, d):
    both = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    test = predicates.contains_text(["c_name"], "77") | predicates.contains_text(["n_name"], "Nation_3") | predicates.contains_text(["c_mktsegment"], "house")
    return both.where(test).select("c_custkey", "c_name", F.coalesce("n_name", F.lit("-")).alias("n_name"))


# Counters and status


@query("""SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS won, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS lost, CAST(sum(CASE WHEN o_orderstatus NOT IN ('F', 'O') OR o_orderstatus IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unknown FROM orders GROUP BY o_custkey""")
def outcome_counts(spark, d):
    s = F.col("o_orderstatus")
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(s == "F").alias("won"), F.count_if(s == "O").alias("lost"), F.count_if(~s.isin("F", "O") | s.isNull()).alias("unknown"))


@query("""SELECT l_orderkey, arg_max(l_partkey, struct_pack(a := l_extendedprice, b := -l_partkey)) AS l_partkey, max(l_extendedprice) AS best FROM lineitem GROUP BY l_orderkey""")
def best_of_each(spark, d):
    return A.best_of_each(t(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_extendedprice").alias("best")), ["l_orderkey"], "best", ["l_partkey"])


@query("SELECT count(*) AS n, CAST(sum(CASE WHEN l_discount = 0 AND l_tax = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero FROM lineitem")
def zero_rows(spark, d):
    none = reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit(0.0)) == 0 for c in ("l_discount", "l_tax")])
    return t(spark, d, "lineitem").agg(F.count("*").alias("n"), F.count_if(none).alias("zero"))


@query("SELECT p_type, CAST(row_number() OVER (ORDER BY p_type) AS BIGINT) AS position FROM (SELECT DISTINCT p_type FROM part)")
def distinct_values(spark, d):
    return windows.ranked_strings(t(spark, d, "part").select("p_type").distinct(), "p_type")


_COUNTED = ("region", "nation", "customer", "supplier", "part", "orders")


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, (SELECT count(*) FROM {n}) AS n_rows, (SELECT count(*) FROM {n}) > 0 AS ready" for n in _COUNTED))
def table_status(spark, d):
    counted = [t(spark, d, n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("name"), "n_rows", (F.col("n_rows") > 0).alias("ready")) for n in _COUNTED]
    return reduce(lambda a, b: a.unionByName(b), counted)


@query("""WITH a AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer WHERE c_custkey % 4 <> 0), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS v FROM customer WHERE c_custkey % 5 <> 0)
SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'scratched' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'active' ELSE 'changed' END AS status, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def status_counts(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    new = c.where("k % 5 <> 0").withColumn("v", F.when(F.col("k") % 3 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return joins.reconcile(c.where("k % 4 <> 0"), new, "k", "v").groupBy("status").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(CASE WHEN n >= 2 THEN 2 ELSE 0 END) AS BIGINT) AS ok, CAST(sum(CASE WHEN n > 2 THEN n - 2 ELSE 0 END) AS BIGINT) AS ambiguous, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS unmatched FROM g""")
def match_counters(spark, d):
    return A.match_counters(t(spark, d, "orders").select("o_custkey"), "o_custkey")


@query("""SELECT l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) AS mean, quantile_cont(l_quantity, 0.1) AS p10, quantile_cont(l_quantity, 0.9) AS p90,
sqrt(CAST(count(*) * sum(CAST(l_quantity AS BIGINT) * CAST(l_quantity AS BIGINT)) - sum(CAST(l_quantity AS BIGINT)) * sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / CAST(count(*) * count(*) AS DOUBLE)) AS stdev FROM lineitem GROUP BY l_returnflag""")
def population_summary(spark, d):
    return A.population_summary(t(spark, d, "lineitem").select("l_returnflag", "l_quantity"), ["l_returnflag"], "l_quantity")


# Order


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1""")
def newest_of_each(spark, d):
    return joins.latest(t(spark, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], [F.desc("ts"), "event_id"]).drop("ts")


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, c_name) AS shown FROM customer ORDER BY 2 DESC, c_custkey LIMIT 50")
def coalesced_order(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", F.coalesce(F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")), F.col("c_name")).alias("shown"))
    return topk.page(rows, [F.desc("shown"), "c_custkey"], 50)


@query("SELECT p_partkey, p_name FROM part ORDER BY lower(p_name), p_partkey LIMIT 100")
def chosen_order(spark, d):
    return topk.sorted_by(t(spark, d, "part").select("p_partkey", "p_name"), "p_name", ["p_partkey"]).limit(100)


@query("SELECT 'part' AS kind, p_partkey AS id, p_name AS name FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name FROM customer")
def tagged_union(spark, d):
    sides = [t(spark, d, n).select(F.lit(n).alias("kind"), F.col(k).alias("id"), F.col(v).alias("name")) for n, k, v in (("part", "p_partkey", "p_name"), ("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name"))]
    return reduce(lambda a, b: a.unionByName(b), sides)


@query("SELECT s_suppkey, s_suppkey AS id FROM supplier WHERE s_suppkey < 10 UNION ALL SELECT s_suppkey, CAST(9 + row_number() OVER (ORDER BY s_suppkey) AS BIGINT) FROM supplier WHERE s_suppkey >= 10")
def appended_ids(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").alias("id"))
    return sinks.appended(s.where("s_suppkey < 10"), s.where("s_suppkey >= 10").drop("id"), "id", ["s_suppkey"])


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 AND n_nationkey < 10 THEN 'other' ELSE n_name END AS n_name FROM nation")
def override_rows(spark, d):
    n = t(spark, d, "nation").select("n_nationkey", "n_name")
    once = n.where("n_nationkey % 2 = 0 and n_nationkey < 10").withColumn("n_name", F.lit("other"))
    twice = n.where("n_nationkey > 15").withColumn("n_name", F.lit("lost"))
    blank = n.where("n_nationkey = 11").withColumn("n_name", F.lit(" "))
    return readers.overridden(n, once.union(twice).union(twice).union(blank), "n_nationkey", ["n_name"])


# Slates and marts

_P = "SELECT c_custkey AS k, CASE WHEN c_custkey < 1000000 THEN lpad(CAST(c_custkey AS VARCHAR), 6, '0') ELSE CAST(c_custkey AS VARCHAR) END AS player_id, c_name AS player_name, 'f' || CAST(c_custkey // 2 AS VARCHAR) AS fight_id, 40.0::DOUBLE + c_custkey % 17 * 3 AS m, (40.0::DOUBLE + c_custkey % 17 * 3) * 1.6::DOUBLE AS c, 5.0::DOUBLE + c_custkey % 9 * 4 AS own FROM customer"


@query(f"""SELECT fight_id, sum(m) AS mean_sum, sum(c) AS ceiling_sum, max(c) AS fight_ceiling, 0.6::DOUBLE * sum(m) + 0.4::DOUBLE * sum(c) AS stack, arg_max(player_name, struct_pack(a := own, b := player_name)) AS chalk_side FROM ({_P}) GROUP BY fight_id""")
def fight_cards(spark, d):
    return slate.fights(_as_players(t(spark, d, "customer"))).drop("members")


@query("""WITH p AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 >= 2 THEN 'a' || (c_custkey // 2) || ' vs b' || (c_custkey // 2) END AS fight_id FROM customer),
w AS (SELECT *, row_number() OVER (PARTITION BY fight_id ORDER BY c_custkey) AS seat, count(*) OVER (PARTITION BY fight_id) AS n, lead(c_name) OVER (PARTITION BY fight_id ORDER BY c_custkey) AS l, lag(c_name) OVER (PARTITION BY fight_id ORDER BY c_custkey) AS g FROM p)
SELECT c_custkey, fight_id, CASE WHEN fight_id IS NULL OR seat > 2 THEN NULL WHEN seat = 1 THEN 'A' ELSE 'B' END AS side, CASE WHEN fight_id IS NULL THEN NULL WHEN seat = 1 THEN l WHEN seat = 2 THEN g END AS opponent,
CASE WHEN fight_id IS NULL OR n = 1 THEN 'unmatched' WHEN seat > 2 THEN 'ambiguous' ELSE 'ok' END AS status FROM w""")
def fight_sides(spark, d):
    k = F.col("c_custkey")
    half = F.floor(k / 2).cast("string")
    info = F.concat(F.lit("A"), half, F.when(k % 10 < 2, "").otherwise(F.concat(F.lit("@B"), half, F.lit(" 03/07/2026 06:00PM ET"))))
    players = t(spark, d, "customer").select("c_custkey", F.lpad(k.cast("string"), 12, "0").alias("player_id"), F.col("c_name").alias("player_name"), info.alias("game_info"))
    return slate.fight_map(players).select("c_custkey", "fight_id", "side", "opponent", "status")


@query(f"""SELECT metric, player_id, value, rank FROM (SELECT metric, player_id, value, CAST(row_number() OVER (PARTITION BY metric ORDER BY value DESC, player_id) AS INTEGER) AS rank FROM (
SELECT 'proj_mean' AS metric, player_id, m AS value FROM ({_P}) UNION ALL SELECT 'proj_ceiling', player_id, c FROM ({_P}) UNION ALL SELECT 'value', player_id, m / 8.0::DOUBLE FROM ({_P}) UNION ALL SELECT 'own_proj', player_id, own FROM ({_P}))) WHERE rank <= 10""")
def slate_boards(spark, d):
    return topk.leaders(_as_players(t(spark, d, "customer")), "player_id", ["proj_mean", "proj_ceiling", "value", "own_proj"])


@query(f"""SELECT player_id, m * 0.72::DOUBLE AS proj_mean, m * 0.5::DOUBLE * 0.68::DOUBLE AS proj_floor, c * 0.78::DOUBLE AS proj_ceiling, (0.35::DOUBLE + 0.65::DOUBLE * p) AS win_gate, (0.55::DOUBLE + 0.45::DOUBLE * p) AS ceiling_gate,
greatest(3.0::DOUBLE, least(42.0::DOUBLE, 24.0::DOUBLE * p + 18.0::DOUBLE * q)) AS own_guess FROM (SELECT *, 0.3::DOUBLE + k % 5 * 0.1::DOUBLE AS p, 0.1::DOUBLE + k % 4 * 0.1::DOUBLE AS q FROM ({_P}))""")
def optimizer_scale(spark, d):
    p = _as_players(t(spark, d, "customer"))
    s = D.standardized(F.col("proj_mean"), F.col("proj_floor"), F.col("proj_ceiling"), F.col("risk"), F.col("salary"))
    gates = D.gates(F.col("p_win"))
    return p.select("player_id", s["proj_mean"].alias("proj_mean"), s["proj_floor"].alias("proj_floor"), s["proj_ceiling"].alias("proj_ceiling"), gates["mean"].alias("win_gate"), gates["ceiling"].alias("ceiling_gate"), D.ownership_guess(F.col("p_win"), F.col("finish_equity")).alias("own_guess"))


_KEYS = {1: "Significant Strikes", 2: "Takedowns %", 3: "Head", 4: "Knockdowns", 5: "Control Time", 6: "Distance Strikes", 7: "Total Strikes"}
_Q, _N = "CAST(l_quantity AS BIGINT)", "l_linenumber"
_PAIR_OF = {"sig": 1, "tot": 7, "td": 2, "head": 3, "body": 0, "leg": 0, "dist": 6, "clinch": 0, "ground": 0}
_ROUND_SQL = ", ".join(
    [f"CAST(max(CASE WHEN n = {i} THEN q END) AS DOUBLE) AS {c}_landed, CAST(max(CASE WHEN n = {i} THEN q + n END) AS DOUBLE) AS {c}_attempted" for c, i in _PAIR_OF.items()]
    + [f"CAST(max(CASE WHEN n = {i} THEN q END) AS DOUBLE) AS {c}" for c, i in {"kd": 4, "sub_att": 0, "rev": 0, "passes": 0}.items()]
    + ["CAST(max(CASE WHEN n = 5 THEN q * 60 + n END) AS DOUBLE) AS ctrl_sec"]
)


def _long_rounds(spark, d):
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("long")
    key = F.element_at(F.create_map(*[F.lit(x) for pair in _KEYS.items() for x in pair]), n)
    value = F.when(n == 4, q.cast("string")).when(n == 5, F.concat(q, F.lit(":0"), n)).otherwise(F.concat(q, F.lit(" of "), q + n))
    none = F.lit(None).cast("double")
    return t(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("fight_url"), F.lit(1).alias("round"), F.concat(F.lit("f"), F.col("l_suppkey") % 2).alias("ss_fighter"), F.lit("x").alias("fighter_id"), key.alias("stat_key"), none.alias("a_landed"), none.alias("a_attempted"), value.alias("a_value")
    )


@query(f"""SELECT fight_url, round, ss_fighter, fighter_id, {_ROUND_SQL} FROM (SELECT CAST(l_orderkey AS VARCHAR) AS fight_url, 1 AS round, 'f' || (l_suppkey % 2) AS ss_fighter, 'x' AS fighter_id, CAST({_N} AS BIGINT) AS n, {_Q} AS q FROM lineitem) GROUP BY 1, 2, 3, 4""")
def round_measures(spark, d):
    """The 23 measures of each fighter's round from long statistics."""
    return A.round_statistics(_long_rounds(spark, d))


@query("""WITH f AS (SELECT CAST(o_orderkey AS VARCHAR) AS fight_url, 'f0' AS fighter, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0 END AS is_win FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'f1', CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN 1 END FROM orders),
l AS (SELECT CAST(l_orderkey AS VARCHAR) AS fight_url, 'f' || (l_suppkey % 2) AS fighter, CAST(max(CASE WHEN l_linenumber = 1 THEN CAST(l_quantity AS BIGINT) END) AS INTEGER) AS sig_landed, CAST(max(CASE WHEN l_linenumber = 4 THEN CAST(l_quantity AS BIGINT) END) AS INTEGER) AS kd, CAST(max(CASE WHEN l_linenumber = 5 THEN CAST(l_quantity AS BIGINT) * 60 + 5 END) AS INTEGER) AS ctrl_sec FROM lineitem GROUP BY 1, 2)
SELECT f.fight_url, f.fighter, CAST(is_win AS INTEGER) AS is_win, sig_landed, kd, ctrl_sec, 2 * 300 + 90 AS fight_seconds FROM f LEFT JOIN l ON f.fight_url = l.fight_url AND f.fighter = l.fighter""")
def fight_facts(spark, d):
    """Two rows of each fight with outcome and totals."""
    s = F.col("o_orderstatus")
    fights = t(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("fight_url"), F.lit("f0").alias("fighter_a"), F.lit("f1").alias("fighter_b"), F.when(s == "F", " F0 ").when(s == "O", "f1").otherwise("nobody").alias("winner"),
        F.lit("w").alias("weight_class"), F.lit("KO").alias("method"), F.lit("3").alias("round"), F.lit("1:30").alias("time"),
    )
    totals = _long_rounds(spark, d).select("fight_url", F.col("ss_fighter").alias("fighter"), "stat_key", F.lit(None).cast("int").alias("a_landed"), F.lit(None).cast("int").alias("a_attempted"), "a_value")
    return marts.fighter_fights(fights, totals).select("fight_url", "fighter", "is_win", "sig_landed", "kd", "ctrl_sec", "fight_seconds")


@query("""WITH f AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS is_win, CAST(round(o_totalprice) AS BIGINT) AS points FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM f)
SELECT o_custkey, count(*) AS fights, CAST(sum(is_win) AS BIGINT) AS wins, CAST(sum(CASE WHEN n <= 5 THEN points END) AS DOUBLE) / count(CASE WHEN n <= 5 THEN points END) AS last5_avg, CAST(sum(CASE WHEN n <= 5 THEN coalesce(is_win, 0) END) AS DOUBLE) / count(CASE WHEN n <= 5 THEN 1 END) AS last5_win_rate,
max(CASE WHEN n = 1 THEN o_orderkey END) AS latest FROM r GROUP BY o_custkey""")
def fighter_history(spark, d):
    """A fighter's profile: record, the last five fights' average and win rate, and the latest fight."""
    s, last5 = F.col("o_orderstatus"), F.col("n") <= 5
    f = t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.when(s == "F", 1).when(s == "O", 0).alias("is_win"), F.round("o_totalprice").cast("long").alias("points"))
    ranked = f.withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))))
    rows = F.count_if(last5)
    return ranked.groupBy("o_custkey").agg(
        F.count("*").alias("fights"), F.sum("is_win").alias("wins"), (F.sum(F.when(last5, F.col("points"))).cast("double") / F.count(F.when(last5, F.col("points")))).alias("last5_avg"),
        (F.sum(F.when(last5, F.coalesce("is_win", F.lit(0)))).cast("double") / rows).alias("last5_win_rate"), F.max(F.when(F.col("n") == 1, F.col("o_orderkey"))).alias("latest"),
    )


@query("""SELECT s_suppkey, s_nationkey, s_acctbal, CASE WHEN s_acctbal < 0 OR s_acctbal > 9000 THEN true ELSE false END AS outside FROM supplier""")
def bounded_balance(spark, d):
    return t(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal", predicates.suspicious(["s_acctbal"], [], {"s_acctbal": 9000}).alias("outside"))


@query("SELECT p_partkey, lower(p_name) AS key, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS title FROM part")
def keys_and_titles(spark, d):
    return t(spark, d, "part").select("p_partkey", X.norm_key(F.concat(F.lit(" "), F.col("p_name"))).alias("key"), X.title_key(F.col("p_type")).alias("title"))


# Projections

_H = "substr(md5(CAST({} AS VARCHAR)), 1, 12)"
_PROJECTION_SQL = f"""WITH c AS (SELECT c_custkey AS k, c_custkey // 10 AS s, CASE WHEN c_custkey % 2 = 0 THEN c_custkey + 1 ELSE c_custkey - 1 END AS o FROM customer),
ids AS (SELECT k, CASE WHEN k % 20 = 0 THEN 'f' || (k + 1) WHEN k % 10 <> 0 THEN 'f' || k END AS id, CASE WHEN k % 20 = 0 THEN 'alias:1.00' WHEN k % 10 <> 0 THEN 'exact:1.00' ELSE 'none:0.00' END AS m FROM c),
l AS (SELECT 'f' || o_custkey AS id, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS f FROM orders GROUP BY 1),
p AS (SELECT c.k, c.o, a.id, b.id AS oid, a.m, coalesce(b.m, 'none:0.00') AS om, b.k IS NOT NULL AS there, coalesce(x.f % 10, 0) AS sx, coalesce(y.f % 10, 0) AS sy, coalesce(x.f % 7, 0) AS nx, coalesce(y.f % 7, 0) AS ny, coalesce(x.f % 2, 0) AS five
 FROM c JOIN ids a ON c.k = a.k LEFT JOIN ids b ON c.o = b.k LEFT JOIN l x ON x.id = a.id LEFT JOIN l y ON y.id = b.id),
q AS (SELECT *, id IS NOT NULL AND oid IS NOT NULL AS ok, 1 / (1 + exp(-(0.2::DOUBLE * (sx - sy) + 0.1::DOUBLE * (nx - ny) + 0.05::DOUBLE))) AS pw, 1 / (1 + exp(-(0.3::DOUBLE * (sx - sy) - 0.4::DOUBLE))) AS pf FROM p)
SELECT k AS player_id, CASE WHEN there OR k % 3 = 2 THEN 'Ann ' ELSE '' END || {_H.format("o")} AS opponent_name, id AS fighter_id, oid AS opponent_id,
round(CASE WHEN ok THEN greatest(0.05, least(0.95, pw)) ELSE 0.5 END, 6) AS p_win, round(CASE WHEN ok THEN greatest(0.02, least(0.8, pf)) ELSE 0.35 END, 6) AS p_finish_given_win,
CASE WHEN ok THEN greatest(0.5, least(8.0, sx)) ELSE 3.0 END::DOUBLE AS pace_sig_land_pm, ok AND five = 1 AS is_5_round,
CASE WHEN ok THEN 'model_ok' ELSE 'missing_fighter_match' END || ' f=' || m || ' o=' || om AS edge_note FROM q"""


@query(_PROJECTION_SQL)
def projected_players(spark, d):
    """Every customer as a player of a slate of ten, against the next one; orders are the fights."""
    short = lambda k: F.substring(F.md5(k.cast("string").cast("binary")), 1, 12)
    k = F.col("player_id")
    o = F.when(k % 2 == 0, k + 1).otherwise(k - 1)
    own, other = short(k), short(o)
    full = lambda h: F.concat(F.lit("Ann "), h)
    game = F.when(k % 3 == 1, F.concat(own, F.lit("@"), other, F.lit(" 03/07/2026 06:00PM ET"))).when(k % 3 == 2, F.concat(full(other), F.lit("@"), full(own), F.lit(" 03/07/2026 06:00PM ET")))
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("player_id"))
    players = c.select("player_id", F.floor(k / 10).cast("string").alias("slate_id"), full(own).alias("player_name"), F.when(k % 3 == 0, other).alias("opponent_name"), game.alias("game_info"))
    fighters = c.where("player_id % 10 <> 0").select(F.concat(F.lit("f"), k).alias("fighter_id"), F.lower(full(own)).alias("name_norm"))
    aliases = c.where("player_id % 20 = 0").select(F.lit("dk").alias("source"), full(own).alias("raw_name"), F.concat(F.lit("f"), k + 1).alias("fighter_id"))
    f = F.col("o_orderkey")
    json = F.to_json(F.struct((f % 10).alias("pre_last3_sig_land_pm"), (f % 7).alias("pre_fights_count"), (f % 2 == 1).alias("is_5_round")))
    orders = t(spark, d, "orders").select(f.alias("fight_id"), F.col("o_orderdate").alias("fight_date"), F.concat(F.lit("f"), "o_custkey").alias("fighter_id"), json.alias("payload_json"))
    win = ({"diff_pre_last3_sig_land_pm": 0.2, "diff_pre_fights_count": 0.1}, 0.05)
    out = projection.projected(players, fighters, aliases, orders.select("fight_id", "fighter_id", "payload_json"), orders.select("fight_id", "fight_date"), win, ({"diff_pre_last3_sig_land_pm": 0.3}, -0.4))
    return out.select("player_id", "opponent_name", "fighter_id", "opponent_id", F.round("p_win", 6).alias("p_win"), F.round("p_finish_given_win", 6).alias("p_finish_given_win"), "pace_sig_land_pm", "is_5_round", "edge_note")


# Display, samples and logs


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN '-' ELSE printf('%.2f', s_acctbal) END AS balance, printf('%.1f', (s_suppkey % 16) * 6.25 * 2) || '%' AS share,
CAST(s_suppkey % 90 + 1 AS VARCHAR) || ' lb' AS weight FROM supplier""")
def shown_figures(spark, d):
    k = F.col("s_suppkey")
    balance = display.fixed(F.when(k % 9 != 0, F.col("s_acctbal")))
    return t(spark, d, "supplier").select("s_suppkey", balance.alias("balance"), display.percent_of((k % 16) / 8.0).alias("share"), display.whole_units(k % 90 + 0.5, "lb").alias("weight"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE strftime(CAST(o_orderdate AS DATE) + INTERVAL 1 DAY, '%-m/%-d/%Y') || ', 1:30:00 AM' END AS shown FROM orders""")
def local_times(spark, d):
    iso = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T16:30:00Z"))
    return t(spark, d, "orders").select("o_orderkey", display.local_time(F.when(F.col("o_orderkey") % 5 == 0, "soon").otherwise(iso), "Asia/Tokyo").alias("shown"))


@query("SELECT p_partkey, p_name FROM part ORDER BY md5('7:' || p_partkey), p_partkey LIMIT 8")
def sampled_parts(spark, d):
    return topk.random_sample(t(spark, d, "part"), 8, "p_partkey", 7).select("p_partkey", "p_name")


_STATES = """SELECT n_nationkey AS target, n_nationkey % 4 <> 1 AS was, n_nationkey % 4 <> 2 AS is_, n_name, CAST(n_regionkey AS VARCHAR) AS r, n_nationkey % 3 = 0 AS moved FROM nation"""


@query(f"""SELECT 'admin' AS actor, target, 'n_name' AS action, CASE WHEN was THEN n_name END AS old_value, CASE WHEN is_ THEN n_name END AS new_value FROM ({_STATES}) WHERE was <> is_
UNION ALL SELECT 'admin', target, 'n_regionkey', CASE WHEN was THEN r END, CASE WHEN is_ THEN CASE WHEN NOT moved THEN r END END FROM ({_STATES}) WHERE (CASE WHEN was THEN r END) IS DISTINCT FROM (CASE WHEN is_ AND NOT moved THEN r END)""")
def audit_log(spark, d):
    n = t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    k = F.col("n_nationkey")
    new = n.where(k % 4 != 2).withColumn("n_regionkey", F.when(k % 3 != 0, F.col("n_regionkey")))
    return sinks.audit_entries(n.where(k % 4 != 1), new, "n_nationkey", ["n_name", "n_regionkey"], "admin", F.current_timestamp()).drop("created_at")


@query("SELECT 'customers' AS key, CAST(count(*) AS VARCHAR) AS value FROM customer UNION ALL SELECT 'last', max(c_name) FROM customer")
def build_metadata(spark, d):
    return sinks.key_values(t(spark, d, "customer").agg(F.count("*").alias("customers"), F.max("c_name").alias("last")))
