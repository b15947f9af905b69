"""Readers, sinks and small functions on files and rows of their own."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from strikeframe.functions import domain, parse, urls
from strikeframe.functions import text as X
from strikeframe.operators import audit, predicates, reshape, topk
from strikeframe.plans import marts, model, slate
from strikeframe.sources import readers, sinks


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).collect()[0])


def values(spark, texts, f):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "c string").select(f(F.col("c"))).collect()]


def test_feeds(spark, tmp_path):
    rows = [{"title": "a", "url": "u1", "published_at": "2024-01-02T00:00:00Z"}, {"title": "b", "url": "u2", "published_at": "2024-03-02T00:00:00Z"}, {"title": "c", "url": "u0"}, "no object", 7]
    (tmp_path / "f.json").write_text(json.dumps(rows))
    (tmp_path / "broken.json").write_text('[{"title": ')
    assert [r.title for r in readers.feed(spark, str(tmp_path / "f.json")).collect()] == ["b", "a", "c"]
    assert [r.title for r in readers.feed(spark, str(tmp_path / "f.json"), limit=1).collect()] == ["b"]
    assert readers.feed(spark, str(tmp_path / "broken.json")).collect() == [] and readers.feed(spark, str(tmp_path / "none.json")).collect() == []


def test_catalog(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("sf_three")
    spark.range(5).createOrReplaceTempView("sf_five")
    readers.require_tables(spark, ["sf_three", "sf_five"])
    with pytest.raises(ValueError, match="sf_none"):
        readers.require_tables(spark, ["sf_none"])
    assert [tuple(r) for r in readers.catalog_listing(spark, {"sf_three", "sf_five"}, counts=True).collect()] == [("sf_five", 5), ("sf_three", 3)]
    assert [r.id for r in readers.preview(spark, "sf_five", {"sf_five"}, ["id"], 2, 1).collect()] == [1, 2]
    with pytest.raises(ValueError):
        readers.preview(spark, "sf_five", {"sf_three"}, ["id"])
    assert readers.discovered(spark.sql("SELECT 'x' AS Name, 1 AS b"), {"name": ["fighter", "name"], "reach": ["reach_in"]}).collect()[0] == ("x", None)
    assert readers.discovered(spark.range(1), {"name": ["name"]}) is None


def test_slates_and_payloads(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Position,Name + ID,Name,ID,Roster Position,Salary,Game Info,TeamAbbrev,AvgPointsPerGame\nF,A (1), Al Bo ,1,F,"$8,100",A@B 03/07/2026 06:00PM ET,T,\nF,B (2),Cy Do,2,F,,A@B 03/07/2026 06:00PM ET,T,7.5\n')
    rows = readers.slate(spark, str(tmp_path / "s.csv"), "s1")
    assert [(r.player_id, r.player_name, r.salary, r.avg_points_per_game, json.loads(r.raw_json)["ID"]) for r in rows.collect()] == [("1", "Al Bo", 8100, 0.0, "1")]
    small = readers.minimal_slate(spark, str(tmp_path / "s.csv")).collect()
    assert [(r.player_id, r.fight_id, r.proj) for r in small] == [("1", "A@B 03/07/2026 06:00PM ET", 0.0), ("2", "A@B 03/07/2026 06:00PM ET", 7.5)]
    blocks = slate.player_pool(rows).collect()
    assert blocks[0].fight_id == "a vs b" and blocks[0].fighters[0].proj == 8.1 * 6.5
    old = rows.withColumn("salary", F.lit(1)).unionByName(rows.withColumn("player_id", F.lit("9")))
    assert sorted((r.player_id, r.salary) for r in readers.slate_state(old, rows).collect()) == [("1", 8100), ("9", 8100)]
    payload = readers.feature_payloads(spark.sql("SELECT 'f' AS fight_id, 'a' AS fighter_id, double('NaN') AS x, 2.0D AS y")).collect()[0].payload_json
    assert json.loads(payload) == {"fight_id": "f", "fighter_id": "a", "y": 2.0}
    models = spark.createDataFrame([("win", '{"feature_cols": ["a"], "w": [0.5], "b": 1.0, "n": 3}')], "model_name string, payload_json string")
    assert tuple(readers.model_row(models, "win").collect()[0]) == ("win", ["a"], [0.5], 1.0, 3)
    with pytest.raises(LookupError):
        readers.model_row(models, "finish")


def test_aliases_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("raw_name,fighter_id,candidate_1\n Al BO,0123456789abcdef,\nCy,,0123456789abcde0 | cy do | 95.0 | x\nNo,,none\n")
    known = spark.createDataFrame([("0123456789abcdef",), ("0123456789abcde0",)], "fighter_id string")
    got = sorted(map(tuple, readers.alias_file(spark, str(tmp_path / "a.csv"), known).collect()))
    assert got == [("Al BO", "0123456789abcdef"), ("Cy", "0123456789abcde0"), ("al bo", "0123456789abcdef"), ("cy", "0123456789abcde0")]
    (tmp_path / "b.csv").write_text("name,id\nx,y\n")
    with pytest.raises(ValueError, match="raw_name"):
        readers.alias_file(spark, str(tmp_path / "b.csv"), known)


def test_typed_tables_and_views(spark, tmp_path):
    (tmp_path / "t.csv").write_text("k,v\n1,2.5\n2,\n")
    readers.typed_tables(spark, {"sf_typed": (str(tmp_path / "t.csv"), "k int, v double")}, {"sf_typed_view": "sf_typed"})
    assert [tuple(r) for r in spark.table("sf_typed_view").orderBy("k").collect()] == [(1, 2.5), (2, None)]
    readers.typed_tables(spark, {"sf_typed": (str(tmp_path / "t.csv"), "k string, v string")})
    assert spark.table("sf_typed").schema.simpleString() == "struct<k:string,v:string>"
    spark.sql("DROP TABLE sf_typed")


def test_frontier(spark):
    pages = spark.createDataFrame([("http://h/a", '<a href="http://h/b"><a href="http://h/a#x">'), ("https://h/b", '<a href="http://h/c">')], "url string, html string")
    got = readers.crawl_frontier(pages.select("url").limit(1), pages, 3).collect()
    assert [tuple(r) for r in got] == [("https://h/a", 0), ("https://h/b", 1), ("https://h/c", 2)]


def test_work_and_exports(spark, tmp_path):
    queue = spark.createDataFrame([("a", "queued", 0, None), ("b", "queued", 2, "old"), ("c", "queued", 0, None), ("d", "done", 1, None)], "url string, status string, attempts int, last_error string")
    results = spark.createDataFrame([("a", None), ("b", "late")], "url string, error string")
    got = {r.url: (r.status, r.attempts, r.last_error) for r in sinks.work_done(queue, results, 3).collect()}
    assert got == {"a": ("done", 1, None), "b": ("error", 3, "late"), "c": ("queued", 0, None), "d": ("done", 1, None)}
    document = json.loads(sinks.document(queue.select("url", "attempts"), ["url"], F.lit("2024-01-01")).collect()[0].value)
    assert document["count"] == 4 and document["generated_at"] == "2024-01-01" and document["rows"][0] == {"url": "a", "attempts": 0}
    assert [json.loads(r.value) for r in sinks.documents_of(queue.select("url").where("url = 'a'")).collect()] == [{"url": "a"}]
    sinks.write_report(queue.select("url").orderBy("url").coalesce(1), str(tmp_path / "r"), mark=True)
    text = next((tmp_path / "r").glob("part-*")).read_text(encoding="utf-8")
    assert text.startswith("﻿url\na") and text.count("url") == 1


def test_constraints(spark):
    rows = spark.createDataFrame([(1, "a", 5), (1, "b", -1), (None, "a", 2), (3, "z", 2)], "k int, p string, n int")
    parents = spark.createDataFrame([("a",), ("b",)], "p string")
    got = {r.constraint: r.violations for r in audit.constraints(rows, ["k"], {"n_positive": F.col("n") > 0}, {"p": parents}).collect()}
    assert got == {"key k": 3, "check n_positive": 1, "parent p": 1}


def test_audited_write(spark, tmp_path):
    path, figures = str(tmp_path / "t"), {"n": F.count("*"), "negative": F.count_if(F.col("id") < 0)}
    hard = lambda r: r["negative"] > 0
    assert audit.audited_write(spark.range(5), path, figures, hard) == {"n": 5, "negative": 0}
    with pytest.raises(audit.Refused) as refused:
        audit.audited_write(spark.range(-1, 9), path, figures, hard)
    assert refused.value.report == {"n": 10, "negative": 1} and spark.read.parquet(path).count() == 5
    assert audit.audited_write(spark.range(7), path, figures, hard)["n"] == 7 and spark.read.parquet(path).count() == 7
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_merges_leave_other_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "b", 1), (4, "c", 1), (5, None, 1)], "k int, p string, v int")
    rows.write.partitionBy("p").parquet(path)
    files = lambda p: {f.name for f in (tmp_path / "t" / f"p={p}").glob("*.parquet")}
    before = files("a")
    new = spark.createDataFrame([(3, "d", 2), (5, None, 7), (4, "c", 9)], "k int, p string, v int")
    assert sinks.merge_partitions(spark, path, new, ["k"], "p") == 4
    got = sorted((r.k, r.p, r.v) for r in spark.read.parquet(path).collect())
    assert got == [(1, "a", 1), (2, "a", 1), (3, "d", 2), (4, "c", 9), (5, None, 7)]
    assert files("a") == before and not (tmp_path / "t" / "p=b").exists()


def test_parsing(spark):
    assert values(spark, ["48%", " 7 %", "x", None], parse.percent) == [48.0, 7.0, None, None]
    assert values(spark, ["3 of 4", "1 2 3", ""], parse.both_numbers) == [[3, 4], None, None]
    assert values(spark, ["March 7, 2026", "7.3.26", None], parse.iso_date) == ["2026-03-07", "7.3.26", None]
    assert values(spark, ["12.5 of 20", "3 of 4", "x"], parse.decimal_pair) == [(12.5, 20.0), (3.0, 4.0), None]
    assert values(spark, ["https://h/a//b?q", "x"], X.url_segments) == [["a", "b"], []]
    assert values(spark, ["al-bo-vs-cy-do", "al-bo"], X.sides_of_slug) == [["Al Bo", "Cy Do"], None]
    assert values(spark, ["Method: KO Round: 2", "no"], lambda c: X.label_value(c, "Method", ["Round"])) == ["KO", None]
    assert values(spark, ["0123456789abcdef | a", "a"], X.candidate_id) == ["0123456789abcdef", None]
    assert one(spark, X.salted_hash(F.lit("s"), F.lit("p")))[0].startswith("s$")
    assert one(spark, domain.pounds(F.lit(100.0)), domain.completeness(F.lit("a"), F.lit(" "), F.lit(3)))[1] == 2


def test_addresses(spark):
    base = F.lit("https://h.example/a/b?x=1#y")
    hrefs = ["c", "/c/../d/", "../../e", "//o.example/p", "?q=2", "#z", "http://X.example/k#f", "mailto:a@b", "", "./f?g"]
    got = values(spark, hrefs, lambda c: urls.resolved(base, c))
    assert got == [
        "https://h.example/a/c", "https://h.example/d/", "https://h.example/e", "https://o.example/p", "https://h.example/a/b?q=2", "https://h.example/a/b?x=1#z", "http://X.example/k#f", "mailto:a@b", None, "https://h.example/a/f?g",
    ]
    assert values(spark, ["http://h/a#f", "http://h", "https://h/a/?q#f", "mailto:a@b"], urls.canonical) == ["https://h/a/", "https://h/", "https://h/a/?q", None]
    html = """<A class=x HREF='c'>1</a><a href="/c#t">2</a><a href="http://other.org/">3</a><a href="HTTPS://www.h.example/z">4</a>"""
    assert values(spark, [html], lambda c: urls.page_links(c, base, "h.example")) == [["https://h.example/a/c/", "https://h.example/c/", "https://www.h.example/z/"]]
    assert values(spark, ["x/one-v-two-smith", "x/ab-v-two", "x/one"], lambda c: urls.sides_of_fight(c)["b"]) == ["Two Smith", None, None]


def test_shapes(spark):
    rows = spark.createDataFrame([("f1", "A", "kd", "1"), ("f1", "B", "kd", "0"), ("f1", "A", "td", "2")], "fight string, side string, stat string, v string")
    assert sorted(map(tuple, reshape.side_by_side(rows.drop("fight"), "stat", "side", ["A", "B"], "v").collect())) == [("kd", "1", "0"), ("td", "2", None)]
    nested = reshape.nested(rows, ["side"], ["stat", "v"], "v", "all").orderBy("side").collect()
    assert [[x.stat for x in r.all] for r in nested] == [["td", "kd"], ["kd"]]
    maps = spark.sql("SELECT 1 AS k, map('a', '1', 'b', '2') AS m")
    assert sorted(map(tuple, reshape.entries(maps, "m", ["k"]).collect())) == [(1, "a", "1"), (1, "b", "2")]
    assert one(spark, predicates.flags(a=F.lit(True), b=F.lit(False), c=F.lit(None).cast("boolean")))[0] == ["a"]
    names = spark.createDataFrame([("Al Bo",), ("Zed Al",), ("Cy",)], "n string")
    assert [r.n for r in predicates.search(names, "n", "AL", 1).collect()] == ["Al Bo"] and predicates.search(names, "n", " ").count() == 3
    assert [r.is_win for r in marts.outcome_known(spark.createDataFrame([("W",), ("loss",), ("NC",)], "is_win string")).collect()] == [1, 0, None]
    board = topk.leaders(spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", None)], "i string, m double"), "i", ["m"], 1)
    assert [r.i for r in board.collect()] == ["a"]


def test_training(spark):
    payloads = [('{"win": "1", "a": "2", "b": 3}',), ('{"win": 0, "a": 1, "b": "x"}',), ('{"win": 0.5, "a": 1, "b": 1}',), ("[]",), (None,)]
    rows = model.training_rows(spark.createDataFrame(payloads, "payload_json string"), ["a", "b"]).collect()
    assert [tuple(r) for r in rows] == [([2.0, 3.0], 1.0)]
    # some steps of plain descent from zero
    import numpy as np

    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(60, 2)), (rng.random(60) < 0.4).astype(float)
    frame = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y double")
    w, b = np.zeros(2), 0.0
    for _ in range(7):
        e = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - 0.05 * (x.T @ e / 60 + 1e-3 * w), b - 0.05 * e.mean()
    got = model.descend(frame, 2, steps=7)
    assert np.allclose(got[0], w) and abs(got[1] - b) < 1e-12
    assert model.descend(frame.limit(0), 2, steps=3) == ([0.0, 0.0], 0.0)
    assert dt.date  # the module's dates are those of parse
