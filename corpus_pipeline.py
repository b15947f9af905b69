"""Corpus preparation: the stages that turn raw documents into training tokens.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns its rows; all but the
last return the columns of documents. Labels and benchmark are read from ``sf_dir``.

Defined results, by stage: a null or empty text has a score like any other and goes if it is low; it is no copy of
anything, isn't contaminated, has no entities and no tokens. Rows without an id stay and are no copy of each other; rows
of one id with the same text count as one. Long texts count whole; of copies the smallest id stays. Further columns,
whatever their names (dots, or names of a stage's own columns), come through all stages but the last as they are. Empty
tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeframe.llm import bpe, decontaminate, jaccard, pii, quality
from strikeframe.llm.common import crc_fold, table, written
from strikeframe.llm.queries import SURROGATE_KEY


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more stay."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"), crc_fold("doc_id", 4) != 2, 0.7)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return jaccard.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets surrogates; n_chars follows the new text."""
    new = pii.surrogates(docs, SURROGATE_KEY, count="__entities__", kinds="__kinds__")
    return new.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the number of tokens, the packed ids and the digest of their decoding."""
    import public_tokenizers

    shared = bpe.vocabulary(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    # written, so that encoders and decoders don't hold their vocabularies at the same time
    tokens = written(bpe.encode(docs.select("doc_id", "lang", "source", "text"), shared).drop("text"), "tokens")
    return bpe.decode(tokens, shared).select(
        "doc_id", "lang", "source", bpe.token_count().alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("pii surrogates", pii_surrogates),
    ("byte-level bpe", byte_level_bpe),
]

#: SQL can express neither the classifier nor the surrogates nor the tokens; tests compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
