"""Neighbours against a full scan of every term."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from strikeframe.llm import toxicity


def scan(texts, ids, k):
    """The k nearest of the examples by plain TF-IDF over every term that an example has."""
    counts = {i: Counter(toxicity.WORD.findall(t.lower())) for i, t in texts.items()}
    terms = {x for i in ids for x in counts[i]}
    often = Counter(x for c in counts.values() for x in c)
    raw = {i: {x: (1 + math.log(n)) * math.log((1 + len(texts)) / (1 + often[x])) for x, n in c.items() if x in terms} for i, c in counts.items()}
    unit = {i: {x: v / (math.sqrt(sum(y * y for y in r.values())) or 1) for x, v in r.items()} for i, r in raw.items()}
    return {i: sorted(((-round(sum(v * unit[e].get(x, 0.0) for x, v in u.items()), 9), e) for e in ids))[:k] for i, u in unit.items()}


def test_every_text_has_its_nearest_examples(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(300)]
    texts = {i: " ".join(rng.choice(words, 30)) for i in range(60)}
    labels = [(i, int(i % 4 == 0)) for i in range(0, 60, 2)]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True), k=5).collect()
    want = scan(texts, [i for i, _ in labels], 5)
    for r in got:
        near = [(e, -s) for s, e in want[r.doc_id] if s < 0]
        assert [e.example for e in r.evidence] == [e for e, _ in near] and np.allclose([e.cosine for e in r.evidence], [s for _, s in near])
    assert all(len(r.evidence) > 0 for r in got)


def test_blocks_lose_nothing():
    rng = np.random.default_rng(5)
    full, vectors = np.zeros((200, 400)), []
    for i in range(200):
        terms = np.unique(rng.zipf(1.3, 40) % 400)
        full[i, terms] = rng.integers(1, 5, len(terms)) * np.linspace(1, 6, 400)[terms]
        full[i] /= np.sqrt((full[i] ** 2).sum())
        vectors.append((terms, full[i, terms]))
    index = toxicity.Index(np.arange(200), np.arange(200) % 2, vectors, 400, np.arange(8), block=16)
    at = index.places()
    got = index.nearest(vectors, 7, [at[i] for i in range(200)])
    for i, (places, cosines) in enumerate(got):
        want = sorted((-c, j) for j, c in enumerate(np.round(full @ full[i], 12).tolist()) if c > 0 and j != i)[:7]
        assert index.ids[places].tolist() == [j for _, j in want] and np.allclose(cosines, [-c for c, _ in want])


def test_ties_repeats_nulls_and_empty_tables(spark):
    rows = [(1, "rude awful text here"), (2, "rude awful text here"), (3, "rude awful text here"), (4, None), (5, ""), (6, "12 34"), (7, "calm words only"), (7, "calm words only"), (8, "quite other things")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (7, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels, F.lit(True), k=2).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].score == by[2].score == by[3].score and by[4].score == by[5].score == by[6].score
    assert [e.example for e in by[3].evidence] == [1]  # equal vectors stand as one, the smaller id
    assert toxicity.score(docs.limit(0), labels, F.lit(True)).count() == 0
    assert {r.score for r in toxicity.score(docs, labels.limit(0), F.lit(True)).collect()} == {0.0}


def test_long_texts_are_read_whole(monkeypatch):
    text = " ".join(f"w{'abcdefghij'[i % 10]}x{i}" for i in range(5000))
    whole = toxicity.word_counts(text)
    monkeypatch.setattr(toxicity, "PIECE", 97)
    assert toxicity.word_counts(text) == whole


def test_scores_are_sorted_out_once(monkeypatch):
    """A round compares its own blocks with the best so far, and not all scores again."""
    rng = np.random.default_rng(7)
    vectors = []
    for _ in range(400):
        terms = np.unique(rng.integers(0, 60, 12))
        vectors.append((terms, np.full(len(terms), len(terms) ** -0.5)))
    index = toxicity.Index(np.arange(400), np.arange(400) % 2, vectors, 60, np.arange(60), block=4)
    sizes, plain = [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, *rest, **named: sizes.append(a.size) or plain(a, *rest, **named))
    index.nearest(vectors[:50], 5)
    assert sum(sizes) < 50 * 400


def test_present_terms_and_their_counts():
    vocabulary = toxicity.Vocabulary(["b", "a", "é"], np.ones(3))
    assert sorted(vocabulary.present("A b, b x É2é").tolist()) == [0, 1, 2] and vocabulary.present(None).tolist() == vocabulary.present("x 1").tolist() == []
    terms, n = vocabulary.counted(toxicity.word_counts("A b, b x É2é"))
    assert terms.tolist() == [0, 1, 2] and n.tolist() == [2, 1, 2]
