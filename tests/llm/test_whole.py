"""Very long texts, clashing names, empty tables and repeated rows of the operators; accuracy by class."""

import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strikeframe.llm import bpe, decontaminate, html_text, jaccard, pii, quality, substring, topk, toxicity, warc
from strikeframe.llm import queries as Q



@pytest.fixture(scope="module")
def long_docs(spark):
    """Two near copies of 0.7 MB, an exact copy's copy, and a short text."""
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6):x}" for _ in range(100_000)]
    a = " ".join(words)
    words[1000:1010] = ["changed"] * 10
    b = " ".join(words) + " mail jane.roe@example.org"
    rows = [(5, a, 1), (3, b, 1), (8, a, 2), (9, "short text of no importance", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, size int").repartition(4).persist()


def test_long_texts_are_worked_on_whole(spark, long_docs):
    groups = {r.doc_id: r for r in jaccard.join(long_docs).collect()}
    assert {i: r.component_id for i, r in groups.items()} == {3: 3, 5: 3, 8: 3, 9: 9} and groups[5].n_shingles > 99_000
    found = {r.doc_id: sum(p.end - p.start for p in r.passages) for r in substring.repeats(long_docs).collect()}
    assert set(found) == {5, 8} and min(found.values()) > 600_000
    items = spark.createDataFrame([(1, long_docs.where("doc_id = 5").first().text[-200:])], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.find_items(long_docs, items).collect() if r.item_ids} == {3, 5, 8}
    shared = bpe.vocabulary(long_docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    back = bpe.decode(bpe.encode(long_docs, shared), shared)
    assert back.where(F.col("text") != F.col("decoded").cast("string")).count() == 0
    new = {r.doc_id: r.text for r in pii.surrogates(long_docs, "key").collect()}
    assert "jane.roe@" not in new[3] and new[3][:600_000] != "" and len(new[5]) == len(new[8])
    labels = spark.createDataFrame([(5, 1, 1), (9, 0, 0)], "doc_id long, toxic int, quality int")
    toxic = {r.doc_id: r.score for r in toxicity.score(long_docs, labels, F.lit(True), k=1).collect()}
    assert toxic[3] == toxic[5] == toxic[8]
    good = {r.doc_id: r.score for r in quality.classify(long_docs, labels, F.lit(True)).collect()}
    assert good[5] == good[8]


def test_long_page(spark, tmp_path):
    page = "<article>" + "".join(f"<p>paragraph {i} of many</p>" for i in range(60_000)) + "</article><footer>f</footer>"
    pages = spark.createDataFrame([(1, "http://a/", page, "x"), (2, "http://a/", page, "y")], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got[1] == got[2] == "\n\n".join(f"paragraph {i} of many" for i in range(60_000))
    warc.write(pages.withColumn("payload", F.lit("z")), str(tmp_path / "w"))
    back = {r.page_id: r for r in warc.read(spark, str(tmp_path / "w"), range_bytes=4096).collect()}
    assert back[2].refers_to == 1 and bytes(back[1].payload).decode() == page


def test_clashing_names_and_repeated_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e f g", 1, 2), (1, "a b c d e f g", 1, 2), (2, "A b c d e f g", 3, 4)], "doc_id long, text string, node long, component_id long")
    assert {tuple(r) for r in jaccard.join(docs).collect()} == {(1, 3, 1), (2, 3, 1)}
    assert [r.doc_id for r in jaccard.one_of_each(docs).collect()] == [1] and jaccard.one_of_each(docs).columns == docs.columns
    assert jaccard.one_of_each(docs.limit(0)).count() == 0
    vectors = spark.createDataFrame([(1, [1, 2], 7), (2, [3, 4], 7), (2, [3, 4], 7)], "vec_id long, vector array<long>, score long")
    assert sorted(map(tuple, topk.top_k(vectors, vectors.where("vec_id = 1"), 5).collect())) == [(1, 1, 2, 11), (1, 2, 2, 11)]
    assert topk.top_k(vectors.limit(0), vectors.limit(0), 5).count() == 0
    repeats = substring.without_repeats(docs.withColumn("passages", F.lit(1)))
    assert repeats.columns == ["doc_id", "text", "node", "component_id", "passages", "kept_text"] and repeats.count() == 3
    none = spark.createDataFrame([], "page_id long, url string, html string, digest string")
    warc.write(none, str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("query, label, size, least", [("op3_toxicity", "toxic", "sf0.1", {0: 0.97, 1: 0.5}), ("op8_quality", "quality", "sf0.01", {0: 0.8, 1: 0.9})])
def test_held_out_rows_of_each_class(spark, query, label, size, least):
    """The share of each class that is told; a constant answer would tell none of the other."""
    sf_dir = f"/root/testdata/{size}"
    labels = {r["doc_id"]: r[label] for r in pq.read_table(f"{sf_dir}/labels.parquet").to_pylist()}
    judged = [(r.predicted, labels[r.doc_id]) for r in Q.queries()[query](spark, sf_dir).collect() if r.held_out and labels.get(r.doc_id) is not None]
    for y, share in least.items():
        own = [p == y for p, x in judged if x == y]
        assert sum(own) >= share * len(own), (y, sum(own), len(own))
