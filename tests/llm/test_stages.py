"""The pipeline's stages on tables with further columns, null ids and no rows."""

import os

import corpus_pipeline
from pyspark.sql import functions as F

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_further_columns_come_through(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plain, more = docs, docs.withColumns({"a.b": F.lit(1), "n_words": F.lit("x"), "item_ids": F.lit(2), "statistics": F.lit(3), "__id__": F.lit(4)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        small, large = stage(spark, plain, DATA), stage(spark, more, DATA)
        assert large.columns == more.columns, name
        assert sorted(map(repr, large.select(*small.columns).collect())) == sorted(map(repr, small.collect())), name
        assert large.select("n_words", "`a.b`").distinct().collect() == [("x", 1)], name


def test_null_ids_and_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    text = " ".join(f"word{i}" for i in range(30))
    odd = spark.createDataFrame([(None, text, "en", "s", 3), (None, text, "en", "s", 3), (10**9, None, None, None, None), (10**9 + 1, "", "en", "s", 0)], docs.schema)
    for name, stage in corpus_pipeline.STAGES[1:]:
        got = stage(spark, odd, DATA)
        assert got.count() == 4, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert sorted(r.text or "" for r in got.collect()) == sorted(["", "", text, text]), name


def test_no_rows(spark):
    none = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DATA).collect() == [], name
