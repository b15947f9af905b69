"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words. A vector holds every word that an example has, with (1 + log count) * log(texts / texts with the
word) and length 1; the frequencies are those of all documents. The examples are a bounded sample of the labelled
rows (``EXAMPLES`` of each label, by the order of a hash); of examples with equal vectors one stands for all. Words
that no example has are in no vector: they would shorten all cosines of a text alike, and change no neighbour.

The index cuts the examples into blocks of ``BLOCK``, alike ones together. All but the ``FREQUENT`` commonest terms
have inverted lists, which give an exact part of each cosine, a term at a time. What the common terms can add to it
is bounded in each block by the text's weights times the block's largest ones. Blocks are worked out by falling
bound, a batch of texts at once, until no bound reaches a text's k-th best cosine: the result is that of a full scan.

The neighbours' labels, weighted by cosine, make a vote; the votes of the examples themselves, each without its
own, are calibrated by pool-adjacent-violators with the labels' true shares. Neighbours are given as evidence.

Defined results: null and empty texts, and texts without any term, have no neighbours and the score that such
examples have (without any, the label's share); repeated rows score alike; equal cosines go to the smaller id; of
several labels of one id the larger counts; without labels every score is 0; an empty table gives an empty table;
a long text is read in pieces, whole. Ids and other columns are never inputs of a score, and extra ones are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeframe.llm.common import written
from strikeframe.llm.quality import rising

EXAMPLES, NEIGHBOURS = 4_000, 30
#: Examples in a block of the index, and terms whose weights are held in full.
BLOCK, FREQUENT = 128, 256
#: Texts whose cosines are worked out at once, and characters of a text that are cut into words at once.
TEXTS_AT_ONCE, PIECE = 64, 1 << 20
WORD = re.compile(r"[^\W\d_]+")
_BETWEEN = re.compile(r"[\W\d_]")

Vector = tuple[np.ndarray, np.ndarray]
Neighbours = tuple[np.ndarray, np.ndarray]


def pieces(text: str | None) -> Iterator[list[str]]:
    """The words of a text, a piece at a time."""
    text, at = text or "", 0
    while at < len(text):
        gap = _BETWEEN.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = gap.start() if gap else len(text)
        yield WORD.findall(text[at:end].lower())
        at = end


def word_counts(text: str | None) -> Counter[str]:
    """How often a text has each of its words."""
    out: Counter[str] = Counter()
    for words in pieces(text):
        out.update(words)
    return out


def examples(labels: DataFrame, learn: Column, key: str, label: str, most: int = EXAMPLES) -> tuple[DataFrame, float]:
    """doc_id, y and weight (rows of the label that each stands for) of a bounded sample, and the label's share."""
    known = labels.where(learn & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).cast("long").alias("doc_id")).agg((F.max(label) > 0).cast("int").alias("y"))
    known = written(known, "toxicity-labels")
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    parts = [
        known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumn("weight", F.lit(counts.get(y, 0) / max(1, min(most, counts.get(y, 0)))))
        for y in (0, 1)
    ]
    return written(parts[0].union(parts[1]), "toxicity-examples"), counts.get(1, 0) / max(1, sum(counts.values()))


def with_words(rows: DataFrame) -> DataFrame:
    """doc_id, y, weight, and the words and counts of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [word_counts(t.as_py()) for t in batch.column(3)]
            words, counts = pa.array([list(c) for c in got], pa.list_(pa.string())), pa.array([list(c.values()) for c in got], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], words, counts], names=["doc_id", "y", "weight", "words", "counts"])

    return rows.select("doc_id", "y", "weight", "text").mapInArrow(run, "doc_id long, y int, weight double, words array<string>, counts array<int>")


class Vocabulary:
    """The numbers of the examples' words, and their weights."""

    def __init__(self, words: list[str], weights: np.ndarray | None = None):
        self.words, self.weights = words, weights
        self.number: dict[str, int] | None = None

    def numbers(self, words: Iterable[str], n: int) -> np.ndarray:
        """The numbers of ``n`` words; -1 for those that no example has."""
        if self.number is None:  # made by each worker for itself
            self.number = {w: i for i, w in enumerate(self.words)}
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, n)

    def present(self, text: str | None) -> np.ndarray:
        """The terms that a text has, each once, in any order."""
        words = set().union(*pieces(text))
        terms = self.numbers(words, len(words))
        return terms[terms >= 0]

    def counted(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Terms in order, and their counts."""
        terms, n = self.numbers(counts, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))
        order = np.argsort(terms)
        order = order[np.searchsorted(terms[order], 0) :]
        return terms[order], n[order]

    def vector(self, counts: dict[str, int]) -> Vector:
        """TF-IDF of unit length."""
        terms, n = self.counted(counts)
        raw = (1 + np.log(n)) * self.weights[terms]
        norm = np.sqrt((raw**2).sum())
        return (terms[raw > 0], raw[raw > 0] / norm) if norm else (terms[:0], raw[:0])

    def __getstate__(self) -> dict:
        return {"words": self.words, "weights": self.weights, "number": None}


def frequencies(texts: DataFrame, vocabulary: Vocabulary) -> tuple[int, np.ndarray]:
    """The number of texts, and in how many of them each term is. Each partition adds up its own vector first."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(shared.value.words), np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                total[shared.value.present(t.as_py())] += 1
                n += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(total[some], n))], names=["term", "n"])

    got = texts.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    at, n = np.asarray(got.column(0)), np.asarray(got.column(1))
    out = np.zeros(len(vocabulary.words), np.int64)
    out[at[at >= 0]] = n[at >= 0]
    return int(n[at < 0].sum()), out


class Index:
    """The examples in blocks: inverted lists of most terms, and full weights of the frequent ones with their maxima."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: list[Vector], width: int, frequent: np.ndarray, block: int = BLOCK):
        self.block, self.column = block, np.full(width, -1, np.int32)
        self.column[frequent] = np.arange(len(frequent))
        rows = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        terms = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in vectors)])
        weights = np.concatenate([np.zeros(0), *(w for _, w in vectors)])
        held = self.column[terms] >= 0
        full = np.zeros((len(vectors), len(frequent)))
        full[rows[held], self.column[terms[held]]] = weights[held]
        # alike examples come together: those whose heaviest frequent term is the same
        order = np.lexsort((ids, full.argmax(1) if full.size else np.zeros(len(ids))))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids, self.labels = np.asarray(ids, np.int64)[order], np.asarray(labels, np.int64)[order]
        self.blocks = -(-len(order) // block)
        self.full = np.zeros((self.blocks, block, len(frequent)))
        self.full.reshape(self.blocks * block, len(frequent))[: len(order)] = full[order]
        self.tops = self.full.max(1) if self.blocks else np.zeros((0, len(frequent)))
        terms, rows, weights = terms[~held], place[rows[~held]], weights[~held]
        by_term = np.lexsort((rows, terms))
        self.starts = np.searchsorted(terms[by_term], np.arange(width + 1)).astype(np.int64)
        self.rows, self.weights = rows[by_term].astype(np.int32), weights[by_term]

    def places(self) -> dict[int, int]:
        return {int(i): k for k, i in enumerate(self.ids)}

    def nearest(self, vectors: list[Vector], k: int, without: list[int] | None = None) -> list[Neighbours]:
        """Of each vector the k examples of largest positive cosine: places and cosines, best first. ``without`` has a
        place for each vector that is left out."""
        n, size = len(self.ids), self.blocks * self.block
        if not n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(vectors)
        part, q = np.zeros((len(vectors), size)), np.zeros((len(vectors), self.tops.shape[1]))
        for i, (terms, weights) in enumerate(vectors):
            often = self.column[terms] >= 0
            q[i, self.column[terms[often]]] = weights[often]
            few, light = terms[~often], weights[~often]
            begin = self.starts[few]
            m = self.starts[few + 1] - begin
            at = np.repeat(begin - (np.cumsum(m) - m), m) + np.arange(m.sum())
            part[i] = np.bincount(self.rows[at], self.weights[at] * np.repeat(light, m), minlength=size)
        part[:, n:] = -np.inf
        if without is not None:
            part[np.arange(len(vectors)), without] = -np.inf
        in_blocks = part.reshape(len(vectors), self.blocks, self.block)
        bounds = in_blocks.max(2) + q @ self.tops.T + 1e-9
        scores = np.full(in_blocks.shape, -np.inf)
        by_bound = np.argsort(-bounds, axis=1, kind="stable")
        rank = np.empty_like(by_bound)
        np.put_along_axis(rank, by_bound, np.arange(self.blocks)[None, :], 1)
        best, least = np.full((len(vectors), k), -np.inf), np.zeros(len(vectors))
        low = 0
        while low < self.blocks:
            high = max(1, 8 * low)
            need = (rank >= low) & (rank < high) & (bounds >= least[:, None]) & (bounds > 0)
            if not need.any():  # later bounds are no larger
                break
            for b in np.flatnonzero(need.any(0)):
                who = np.flatnonzero(need[:, b])
                scores[who, b] = in_blocks[who, b] + q[who] @ self.full[b].T
            if high < self.blocks:  # only what is new is compared with the k best so far
                new = np.take_along_axis(scores, by_bound[:, low:high, None], 1).reshape(len(vectors), -1)
                best = np.partition(np.concatenate([best, new], 1), new.shape[1], axis=1)[:, new.shape[1] :]
                least = np.maximum(least, best.min(1) - 1e-9)
            low = high
        out = []
        for row, enough in zip(np.round(scores.reshape(len(vectors), size), 12), least, strict=True):
            at = np.flatnonzero((row > 0) & (row >= enough))
            if len(at) > k:
                at = at[row[at] >= np.partition(row[at], len(at) - k)[len(at) - k]]
            at = at[np.lexsort((self.ids[at], -row[at]))][:k]
            out.append((at, row[at]))
        return out

    def vote(self, near: Neighbours) -> float:
        """The share of label 1 by cosine; -1 without neighbours."""
        at, cosines = near
        return float((cosines * self.labels[at]).sum() / cosines.sum()) if len(at) else -1.0


def calibration(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray, share: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The score without neighbours, and the edges and levels of a rising function of the vote."""
    some = votes >= 0
    none = float((labels * weights)[~some].sum() / weights[~some].sum()) if (~some).any() else share
    if not some.any():
        return none, np.array([0.0, 1.0]), np.array([0.0, 1.0])
    bins, inverse = np.unique(np.round(votes[some], 2), return_inverse=True)
    mass = np.bincount(inverse, weights[some])
    return none, *rising(bins, np.bincount(inverse, (labels * weights)[some]) / mass, mass)


def index_of(known: pa.Table, texts: DataFrame) -> tuple[Vocabulary, Index, dict[int, float]]:
    """Vocabulary and index of the examples, and the rows that each id stands for."""
    words = known["words"].combine_chunks()
    coded = words.flatten().dictionary_encode()
    vocabulary = Vocabulary(coded.dictionary.to_pylist())
    total, frequency = frequencies(texts, vocabulary)
    vocabulary.weights = np.where(frequency > 0, np.log((1 + total) / (1 + frequency)), 0.0)
    codes, counts = np.asarray(coded.indices, dtype=np.int64), np.asarray(known["counts"].combine_chunks().flatten(), dtype=np.int64)
    bounds = np.cumsum(np.append(0, np.asarray(words.value_lengths(), dtype=np.int64)))
    ids, y, weight = (np.asarray(known[c]) for c in ("doc_id", "y", "weight"))
    chosen: dict[tuple[bytes, bytes, int], int] = {}
    vectors, stands = [], {}
    kept = []
    for r in np.argsort(ids, kind="stable"):
        terms, n = codes[bounds[r] : bounds[r + 1]], counts[bounds[r] : bounds[r + 1]]
        order = np.argsort(terms)
        terms, n = terms[order], n[order]
        same = chosen.setdefault((terms.tobytes(), n.tobytes(), int(y[r])), int(ids[r]))
        stands[same] = stands.get(same, 0.0) + float(weight[r])
        if same == ids[r]:
            raw = (1 + np.log(n)) * vocabulary.weights[terms]
            norm = np.sqrt((raw**2).sum()) or 1.0
            vectors.append((terms[raw > 0], raw[raw > 0] / norm))
            kept.append(r)
    often = np.bincount(codes, minlength=len(vocabulary.words))
    index = Index(ids[kept], y[kept], vectors, len(vocabulary.words), np.argsort(-often, kind="stable")[:FREQUENT])
    return vocabulary, index, stands


def score(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", k: int = NEIGHBOURS) -> DataFrame:
    """doc_id, score and evidence (the ids of the nearest examples and their cosines and labels) of every row."""
    spark = docs.sparkSession
    sample, share = examples(labels, learn, key, label)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # the sample is bounded by its construction, so the texts need no shuffle; of rows that share an id one is the example
    chosen = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y", "weight").agg(F.min("text").alias("text"))
    known = written(with_words(chosen), "toxicity-known")
    vocabulary, index, stands = index_of(known.toArrow(), texts)
    shared = spark.sparkContext.broadcast((vocabulary, index))
    some = len(index.ids)

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own = shared.value
        places = own.places()
        for batch in batches:
            for begin in range(0, len(batch), TEXTS_AT_ONCE):
                rows = [r for r in batch.slice(begin, TEXTS_AT_ONCE).to_pylist() if r["doc_id"] in places]
                vectors = [words.vector(dict(zip(r["words"], r["counts"], strict=True))) for r in rows]
                near = own.nearest(vectors, k, [places[r["doc_id"]] for r in rows]) if rows else []
                yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array(map(own.vote, near), pa.float64()), pa.array([r["y"] for r in rows], pa.int32())], names=["doc_id", "vote", "y"])

    parts = max(1, min(-(-some // 256), 4 * spark.sparkContext.defaultParallelism))
    votes = known.repartition(parts).mapInArrow(voted, "doc_id long, vote double, y int").collect() if some else []
    none, edges, levels = calibration(np.array([r.vote for r in votes]), np.array([float(r.y) for r in votes]), np.array([stands[r.doc_id] for r in votes]), share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own = shared.value
        for batch in batches:
            for begin in range(0, len(batch), TEXTS_AT_ONCE):
                rows = batch.slice(begin, TEXTS_AT_ONCE)
                near = own.nearest([words.vector(word_counts(t.as_py())) for t in rows.column(1)], k)
                votes = np.array([own.vote(x) for x in near])
                scores = np.where(votes >= 0, np.interp(votes, edges, levels), none).clip(0, 1).round(9)
                at = np.concatenate([x for x, _ in near])
                entries = pa.StructArray.from_arrays(
                    [pa.array(own.ids[at]), pa.array(np.concatenate([c for _, c in near])), pa.array(own.labels[at].astype(np.int32))], names=["example", "cosine", "label"]
                )
                evidence = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) for x, _ in near)]), pa.int32()), entries)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(scores), evidence], names=["doc_id", "score", "evidence"])

    return texts.mapInArrow(run, "doc_id long, score double, evidence array<struct<example:bigint,cosine:double,label:int>>")
