"""The queries of the text operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeframe.llm import bpe, decontaminate, divergence, html_text, jaccard, negatives, pii, quality, rules, substring, topk, toxicity, warc
from strikeframe.llm.common import crc_fold, shared_folder, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text of documents."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shared = bpe.vocabulary(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    tokens = bpe.encode(docs, shared).select("doc_id", "ids")
    return bpe.decode(tokens, shared).select(
        "doc_id",
        bpe.token_count().alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page as a WARC record and reads the archives back."""
    path = shared_folder(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""

def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every text of documents for toxicity."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_fold("doc_id", 5) == 0
    return toxicity.score(docs, labels, ~held_out).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.slice("evidence.example", 1, 3).alias("evidence")
    )


#: The key of the queries' surrogates; a real corpus has its own, kept secret.
SURROGATE_KEY = "strikeframe-demonstration"


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents with surrogates for personal data."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.surrogates(docs, SURROGATE_KEY)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every text of documents against the benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of near copies among all documents."""
    return jaccard.join(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every text of documents for quality."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_fold("doc_id", 4) == 2
    return quality.classify(docs, labels, ~held_out).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other rows for every fiftieth embedding."""
    rows = table(spark, sf_dir, "embeddings").where(topk.usable("embedding")).select("vec_id", topk.floored("embedding").alias("vector"))
    return topk.top_k(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages that come earlier in others (or themselves), by pair of document and source."""
    found = substring.repeats(table(spark, sf_dir, "documents")).select("doc_id", F.explode("passages").alias("p"))
    pairs = found.select("doc_id", F.explode("p.source_ids").alias("source_id"), "p")
    return pairs.groupBy("doc_id", "source_id").agg(
        F.count("*").alias("n_passages"), F.sum(F.col("p.end") - F.col("p.start")).alias("passage_bytes"), F.min("p.start").alias("first_start")
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language lie apart, and the terms that mark each of them."""
    return divergence.audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), g AS (SELECT DISTINCT lang, source FROM d),
h AS (SELECT lang, unnest(list_distinct(terms)) AS term FROM d),
k AS (SELECT lang, term FROM h GROUP BY lang, term HAVING count(*) >= 30),
o AS (SELECT lang, source, unnest(terms) AS term FROM d),
c AS (SELECT o.lang, o.source, o.term, CAST(count(*) AS HUGEINT) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v FROM k GROUP BY lang),
z AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (
  SELECT z.lang, z.source, z.term, z.n, v.v, sum(z.n) OVER (PARTITION BY z.lang, z.source) AS total,
    sum(z.n) OVER (PARTITION BY z.lang, z.term) AS lang_n, sum(z.n) OVER (PARTITION BY z.lang) AS lang_total
  FROM z JOIN v USING (lang)
), p AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // CAST(total + 5 * v AS HUGEINT) AS p,
    1 + (1000000000 * CAST(lang_n + 5 AS HUGEINT)) // CAST(lang_total + 5 * v AS HUGEINT) AS q FROM s
), w AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(w.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN w ON w.lang = a.lang AND w.source = a.source AND w.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q
), t AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM t WHERE part = 'pair' OR rank <= 50
"""


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every text of documents and the verdict of the learned rules."""
    return rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_fold("doc_id", 4) != 2)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every hundredth embedding; every seventh label is wrong by one."""
    told = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    known = topk.usable("embedding") & F.col("label").isNotNull()
    rows = table(spark, sf_dir, "embeddings").where(known).select("vec_id", told.alias("label"), topk.floored("embedding").alias("vector"))
    return negatives.mine(rows, rows.where(F.col("vec_id") % 100 == 0))


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    CAST(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
  FROM s WHERE label = anchor_label
), n AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label
    AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
  WHERE p.place <= 5
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def queries() -> dict[str, Query]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_warc": op2_warc,
        "op3_toxicity": op3_toxicity,
        "op4_pii": op4_pii,
        "op5_decontamination": op5_decontamination,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_html_text": op7_html_text,
        "op8_quality": op8_quality,
        "op9_exact_top_k": op9_exact_top_k,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_source_divergence": op11_source_divergence,
        "op12_quality_rules": op12_quality_rules,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op9_exact_top_k": OP9_SQL, "op11_source_divergence": OP11_SQL, "op13_hard_negatives": OP13_SQL}
