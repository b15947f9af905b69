"""Nulls, empty texts, empty tables, clashing names and repeated rows."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strikeframe.llm import bpe, decontaminate, html_text, pii, quality, substring, topk, toxicity, warc

TEXTS = [(1, None, 9), (2, "", 9), (3, "mail ann@example.org or call 555-123-4567", 9), (3, "mail ann@example.org or call 555-123-4567", 9), (None, "x", 9)]


def frame(spark, clash, rows=TEXTS):
    return spark.createDataFrame(rows, f"doc_id long, text string, `{clash}` int")


@pytest.mark.parametrize("rows", [TEXTS, []])
def test_bpe(spark, rows):
    docs = frame(spark, "ids", rows)
    shared = bpe.vocabulary(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    got = bpe.decode(bpe.encode(docs, shared, offsets="spans"), shared).collect()
    assert len(got) == len(rows)
    for r in got:
        assert bytes(r.decoded).decode() == (r.text or "") and len(r.spans) * 4 == len(r.ids)


def test_warc(spark, tmp_path):
    long = "<p>" + "é" * 120
    pages = [(1, "u", None), (2, "u", ""), (3, None, long), (4, "v", long), (5, "v", "same"), (6, "v", "same")]
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.read(spark, str(tmp_path / "w"), range_bytes=64).collect()}
    assert {i: r.refers_to for i, r in got.items()} == {1: None, 2: None, 3: None, 4: 3, 5: None, 6: None}
    assert got[4].record_type == "revisit" and got[4].payload_bytes == len(long.encode()) and bytes(got[3].payload).decode() == long


@pytest.mark.parametrize("rows", [TEXTS, []])
def test_toxicity_and_quality_without_labels(spark, rows):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    docs = frame(spark, "score", rows)
    assert [r.score for r in toxicity.score(docs, none, F.lit(True)).collect()] == [0.0] * len(rows)
    assert [r.score for r in quality.classify(docs, none, F.lit(True)).collect()] == [0.5] * len(rows)


def test_pii(spark):
    got = pii.surrogates(frame(spark, "n_entities"), "key").collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(TEXTS) and by_id[1].text is None and by_id[2].text == "" and by_id[None].text == "x"
    same = {r.text for r in got if r.doc_id == 3}
    assert len(same) == 1 and "ann@" not in same.copy().pop() and by_id[3].n_entities == 2
    assert pii.surrogates(frame(spark, "n_entities", []), "key").collect() == []


def test_decontamination(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.item_ids == [] for r in decontaminate.find_items(frame(spark, "n_words"), none).collect())
    items = spark.createDataFrame([(1, "EXAMPLE org"), (2, None), (3, "...")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_items(frame(spark, "n_words"), items).collect()}
    assert got[3].item_ids == ["1"] and got[1].n_words == 0 and got[2].item_ids == []


def test_html(spark):
    pages = [(1, None, None), (2, "http://a/", ""), (3, "http://a/x", "<nav>m</nav><article><p>A&amp;B\n c<p>d</article><footer>f</footer>")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "", 2: "", 3: "A&B c\n\nd"}
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_top_k(spark):
    rows = [(1, [1, 2]), (2, [2, 1]), (3, [2, 1]), (4, None), (None, [9, 9]), (5, [])]
    v = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = topk.top_k(v, v.where("vec_id = 1"), 2).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 2, 4), (1, 2, 3, 4)]


def test_substring(spark):
    import random

    rng = random.Random(1)
    passage = " ".join(f"word{rng.randrange(5000)}" for _ in range(60))
    rows = [(1, "first " + passage + " end"), (2, "an insertion before " + passage), (3, None), (4, ""), (5, "nothing in common here"), (None, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.passages for r in substring.repeats(docs).collect()}
    assert set(got) == {2} and got[2][0].source_ids == [1] and sum(p.end - p.start for p in got[2]) > 0.6 * len(passage)
    kept = {r.doc_id: r.kept_text for r in substring.without_repeats(docs).collect()}
    assert kept[1] == rows[0][1] and kept[3] is None and kept[4] == "" and len(kept[2]) < len(rows[1][1])
    assert substring.repeats(docs.limit(0)).collect() == []
