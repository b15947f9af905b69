"""The queries over whole tables against plain Python, DuckDB or held-out labels."""

import base64
import hashlib
import os
import re
import zlib
from collections import defaultdict

import duckdb
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken

import corpus_pipeline
from strikeframe.llm import queries as Q

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def load(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def documents():
    return load("documents")


@pytest.fixture(scope="module")
def tokenizer():
    lines = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_op1_as_the_rank_encoder(spark, documents, tokenizer):
    got = {r.doc_id: tuple(r) for r in Q.op1_byte_bpe(spark, DATA).collect()}
    assert len(got) == len(documents)
    for d in documents:
        text = d["text"] or ""
        ids = tokenizer.encode_ordinary(text)
        assert got[d["doc_id"]] == (d["doc_id"], len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = Q.queries()[name](spark, DATA)
    want = con.sql(Q.oracle_sql()[name])
    assert df.columns == want.columns
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def windows_hit(documents, items):
    windows = defaultdict(set)
    for item in items:
        words = ITEM_WORD.findall(lowered(item["text"]))
        n = min(13, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[i : i + n])].add(str(item["item_id"]))
    lengths = {len(w) for w in windows}
    out = {}
    for d in documents:
        words = ITEM_WORD.findall(lowered(d["text"]))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if ids := windows.get(tuple(words[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= ids
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[d["doc_id"]] = (d["doc_id"], len(words), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(words))
    return out


def test_op5_every_window(spark, documents):
    got = {r.doc_id: tuple(r) for r in Q.op5_decontamination(spark, DATA).collect()}
    assert got == windows_hit(documents, load("benchmark"))
    assert any(r[-1] for r in got.values())


def shingles(text):
    words = SPACED_WORD.findall(lowered(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def linked(rows):
    """component by id, by comparing every pair."""
    sets = {i: shingles(t) for i, t in rows}
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            p, q = sets[a], sets[b]
            if p and q and 4 * min(len(p), len(q)) >= 3 * max(len(p), len(q)):
                same = len(p & q)
                if 100 * same >= 75 * (len(p) + len(q) - same):
                    x, y = sorted((root(a), root(b)))
                    least[y] = x
    return {i: (i, len(sets[i]), root(i)) for i in ids}


def test_op6_every_pair(spark, documents):
    got = {r.doc_id: tuple(r) for r in Q.op6_jaccard_join(spark, DATA).collect()}
    assert got == linked([(d["doc_id"], d["text"]) for d in documents])


def held_out_accuracy(got, label):
    labels = {r["doc_id"]: r[label] for r in load("labels") if r[label] is not None}
    judged = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    return sum(p == y for p, y in judged) / len(judged)


def folds(got, parts, left):
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == left) for r in got)
    assert all(0 <= r.score <= 1 for r in got)


def test_op3_held_out(spark, documents):
    got = Q.op3_toxicity(spark, DATA).collect()
    assert len(got) == len(documents)
    folds(got, 5, 0)
    assert held_out_accuracy(got, "toxic") >= 0.85


def test_op8_held_out(spark, documents):
    got = Q.op8_quality(spark, DATA).collect()
    assert len(got) == len(documents)
    folds(got, 4, 2)
    assert held_out_accuracy(got, "quality") >= 0.8


def test_op7_article_text(spark):
    pages = load("pages")
    got = {r.page_id: r for r in Q.op7_html_text(spark, DATA).collect()}
    assert sorted(got) == sorted(p["page_id"] for p in pages)
    for r in got.values():
        assert r.n_chars == len(r.text)
        assert all(b == " ".join(b.split()) for b in r.text.split("\n\n"))


def test_op4_and_op10_cover_their_tables(spark, documents):
    texts = {d["doc_id"]: d["text"] for d in documents}
    new = {r.doc_id: r for r in Q.op4_pii(spark, DATA).collect()}
    assert sorted(new) == sorted(texts)
    assert all((r.text == texts[i]) == (r.n_entities == 0) for i, r in new.items())
    for r in Q.op10_substring_dedup(spark, DATA).collect():
        assert r.doc_id in texts and r.source_id in texts and r.passage_bytes >= 72


def test_pipeline_against_plain_steps(spark, documents, tokenizer):
    """Each stage judged by brute force on what the stage before kept."""
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scores = {r.doc_id: r.predicted for r in Q.op8_quality(spark, DATA).collect()}
    one = stages["quality classifier"](spark, docs, DATA)
    assert {r.doc_id for r in one.collect()} == {i for i, p in scores.items() if p}
    two = stages["n-gram jaccard join"](spark, one, DATA)
    kept = [(r.doc_id, r.text) for r in one.collect()]
    assert {r.doc_id for r in two.collect()} == {i for i, _, c in linked(kept).values() if i == c}
    three = stages["benchmark decontamination"](spark, two, DATA)
    rows = [r.asDict() for r in two.collect()]
    assert {r.doc_id for r in three.collect()} == {i for i, r in windows_hit(rows, load("benchmark")).items() if not r[-1]}
    four = stages["pii surrogates"](spark, three, DATA)
    assert four.columns == docs.columns and four.count() == three.count()
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert set(final) == {r.doc_id for r in three.collect()}
    for r in four.collect():
        assert bytes(final[r.doc_id].ids) == packed(tokenizer.encode_ordinary(r.text or ""))
        assert final[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert r.n_chars == len(r.text or "")
