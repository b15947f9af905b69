"""Queries of crawled pages, their addresses and what their text tells, and of slate files."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikeframe.functions import names, urls
from strikeframe.plans import slate
from strikeframe.plans.registry import query, t
from strikeframe.sources import readers, sinks
from strikeframe.sources.scratch import shared_folder


@query("""WITH l AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages)
SELECT DISTINCT page_id, 'https://' || host || href || '/' AS target FROM l WHERE href LIKE '/%'""")
def crawl_links(spark, d):
    """The distinct canonical links of each page to its own host."""
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    return t(spark, d, "pages").select("page_id", F.explode(urls.page_links(F.col("html"), F.col("url"), host)).alias("target"))


@query("""WITH u AS (SELECT o_orderkey AS k, 'http://x.example/ufc/' || CASE WHEN o_orderkey % 7 = 0 THEN 'news' ELSE 'ufc-fight-statistics' END || CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '/night-' || o_custkey WHEN 2 THEN '/n/jo-o039neil-v-al_bo-' || chr(CAST(97 + o_custkey % 26 AS INTEGER)) ELSE '/n/about' END AS url FROM orders)
SELECT k, CASE WHEN k % 7 = 0 THEN 'other' WHEN k % 4 = 1 THEN 'event' WHEN k % 4 = 2 THEN 'fight' ELSE 'index' END AS kind, replace(url, 'http:', 'https:') || '/' AS canonical,
CASE WHEN k % 4 = 2 THEN 'Jo O''Neil' END AS a, CASE WHEN k % 4 = 2 THEN 'Al Bo ' || upper(right(url, 1)) END AS b FROM u""")
def address_kinds(spark, d):
    """Addresses of events, fights and lists, in canonical form, and the sides that a fight's address names."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    tail = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit("/night-"), c)).when(k % 4 == 2, F.concat(F.lit("/n/jo-o039neil-v-al_bo-"), F.chr(97 + c % 26))).otherwise("/n/about")
    url = F.concat(F.lit("http://x.example/ufc/"), F.when(k % 7 == 0, "news").otherwise("ufc-fight-statistics"), tail, F.when(k % 3 == 0, "#top").when(k % 3 == 1, "/").otherwise(""))
    sides = urls.sides_of_fight(F.regexp_replace(url, "#.*$", ""))
    return t(spark, d, "orders").select(k.alias("k"), urls.kind(url).alias("kind"), urls.canonical(url).alias("canonical"), sides["a"].alias("a"), sides["b"].alias("b"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN 'Al B' || chr(CAST(97 + o_custkey % 26 AS INTEGER)) END AS winner, CASE WHEN o_orderkey % 5 > 0 THEN 'Cy O''Do' END AS loser,
CASE o_orderkey % 4 WHEN 0 THEN 'Decision - Split' WHEN 1 THEN 'KO/TKO' WHEN 2 THEN 'Submission' ELSE 'Decision' END AS method, CAST(1 + o_orderkey % 5 AS INTEGER) AS round, CAST(o_orderkey % 5 AS VARCHAR) || ':' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') AS time FROM orders""")
def told_fights(spark, d):
    """Winner, loser, method, round and time from free text."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name, time = F.concat(F.lit("Al B"), F.chr(97 + c % 26)), F.format_string("%d:%02d", k % 5, c % 60)
    how = F.when(k % 4 == 0, "decision -  split").when(k % 4 == 1, "by tko punches").when(k % 4 == 2, "Submission (choke)").otherwise("a Decision")
    lost = F.when(k % 5 > 0, F.concat(F.lit(" (Win) 12 Cy  O'Do (Loss). "), name, F.lit(" (Loss)"))).otherwise(F.concat(F.lit(" (Win) 12 "), name, F.lit(" (win)")))
    text = F.concat(F.lit("<p>5 "), name, lost, F.lit(" : "), how, F.lit(" ["), F.when(k % 2 == 0, F.concat(F.lit("Round: "), 1 + k % 5)).otherwise(F.concat(F.lit("R"), 1 + k % 5)), F.lit("] "), F.when(k % 3 == 0, F.lit("Time - ")).otherwise(F.lit("at ")), time)
    sides, result = urls.told_sides(text), urls.told_result(text)
    return t(spark, d, "orders").select("o_orderkey", sides["winner"].alias("winner"), sides["loser"].alias("loser"), result["method"].alias("method"), result["round"].alias("round"), result["time"].alias("time"))


@query("""WITH p AS (SELECT page_id AS k, length(html) + length(CASE WHEN page_id % 3 < 2 THEN 'Significant strikes' ELSE 'Strikes' END) + CASE page_id % 4 WHEN 1 THEN length(url) + 14 WHEN 2 THEN 6 WHEN 3 THEN 9 ELSE 25 END AS n FROM pages)
SELECT k AS page_id, n >= 2000 AND k % 3 < 2 AND k % 4 > 0 AS valid FROM p""")
def fight_page_validity(spark, d):
    """Whether a page is long enough and has the marks of a fight's."""
    k = F.col("page_id")
    marks = F.concat(F.when(k % 3 < 2, "Significant strikes").otherwise("Strikes"), F.when(k % 4 == 1, F.concat(F.col("url"), F.lit(" total STRIKES"))).when(k % 4 == 2, " (WIN)").when(k % 4 == 3, " round 1 ").otherwise(" round two, total strikes "))
    return t(spark, d, "pages").select("page_id", names.is_fight_page(F.concat(F.col("html"), marks), F.col("url"), 2000).alias("valid"))


@query("""WITH p AS (SELECT c_custkey AS k, 'f' || lpad(CAST(c_custkey // 2 AS VARCHAR), 9, '0') AS f, 6000 + c_custkey % 40 * 100 AS salary, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey % 50 AS DOUBLE) ELSE 0 END AS average FROM customer WHERE c_custkey % 11 > 0),
r AS (SELECT *, CASE WHEN k % 5 = 0 THEN CAST(k % 70 AS DOUBLE) WHEN average > 0 THEN average ELSE salary / 1000.0::DOUBLE * 6.5::DOUBLE END AS proj FROM p)
SELECT f || ' vs g' || substr(f, 2) AS fight_id, array_to_string(list(lpad(CAST(k AS VARCHAR), 9, '0') || ':' || salary ORDER BY salary DESC, k), ' ') AS fighters, sum(proj) AS proj, count(*) FILTER (WHERE k % 5 = 0) AS n_modelled FROM r GROUP BY 1""")
def player_pool(spark, d):
    """A slate file's players in fight blocks, projected by the model where it knows them; the file is written from customers."""
    k, path = F.col("c_custkey"), shared_folder(spark, "slate")
    half = F.lpad(F.floor(k / 2).cast("string"), 9, "0")
    pid = F.lpad(k.cast("string"), 9, "0")
    file = t(spark, d, "customer").select(
        F.lit("F").alias("Position"), F.concat(F.col("c_name"), F.lit(" ("), k, F.lit(")")).alias("Name + ID"), F.concat(F.lit(" "), F.col("c_name")).alias("Name"), pid.alias("ID"), F.lit("F").alias("Roster Position"),
        F.when(k % 11 > 0, F.concat(F.lit("$"), F.format_number(6000 + k % 40 * 100, 0))).otherwise("-").alias("Salary"), F.concat(F.lit("F"), half, F.lit("@G"), half, F.lit(" 03/07/2026 06:00PM ET")).alias("Game Info"), F.lit("T").alias("TeamAbbrev"),
        F.when(k % 3 > 0, (k % 50).cast("string")).otherwise("").alias("AvgPointsPerGame"),
    )
    sinks.write_report(file, path)
    known = t(spark, d, "customer").where(k % 5 == 0).select(pid.alias("player_id"), (k % 70).cast("double").alias("proj_mean"))
    blocks = slate.player_pool(readers.slate(spark, path, "s1"), known)
    shown = F.array_join(F.transform("fighters", lambda f: F.concat_ws(":", f["player_id"], f["salary"].cast("string"))), " ")
    return blocks.select("fight_id", shown.alias("fighters"), F.aggregate("fighters", F.lit(0.0), lambda s, f: s + f["proj"]).alias("proj"), "n_modelled")
