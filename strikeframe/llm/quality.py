"""Quality classifier: kernel ridge regression by random Fourier features, with isotonic calibration.

Statistics of each text's form go through random cosines, whose inner products approximate a Gaussian kernel.
Every partition adds up its part of the normal equations, per fold of the labelled rows; the sums, of fixed size,
give the ridge weights of all rows and, left-one-fold-out, scores that the rows' own labels have not shaped. On
those, pool-adjacent-violators fits levels that rise with the score; between the blocks' means it is read linearly.

Defined results: a null text counts as empty and has statistics like any other; repeated rows score alike; of
several labels of one key the mean counts; without labelled rows every score is the given prior; empty tables give
empty tables; a text's statistics are those of the whole text. Keys and other columns are never inputs of a score;
``classify`` ignores them, whatever their names, and ``accepted`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeframe.llm import textvec as V
from strikeframe.llm.common import lean, written

STATISTICS = (
    "log_bytes", "log_words", "upper", "lower", "digit", "punctuation", "white", "beyond_ascii", "word_length", "word_length_spread",
    "distinct_words", "repeated_word", "log_lines", "distinct_lines", "line_in_repeats", "words_a_line", "distinct_pairs", "ends_sentence", "distinct_bytes", "top_word",
)
FEATURES = 256
FOLDS = 5
#: Bands of rows that each fold's equations are added up in.
BANDS = 4
RIDGE = 1.0
SEED = 20
#: Widest part of a Gaussian kernel, in standard deviations of the statistics times their number's root.
WIDTH = 1.0

_CLASS = np.zeros((5, 256))
_CLASS[0, 0x41:0x5B] = _CLASS[1, 0x61:0x7B] = _CLASS[2, 0x30:0x3A] = 1
_CLASS[3, [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = 1
_CLASS[4, 0x80:] = 1
_CODE = _CLASS.argmax(0) + (_CLASS.max(0) > 0)


def _per_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, values, minlength=n)


def statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One line of STATISTICS for each row of a batch."""
    n = len(bounds) - 1
    size = np.diff(bounds).astype(float)
    some = np.maximum(size, 1)
    row_of = np.repeat(np.arange(n), np.diff(bounds))
    kinds = np.bincount(row_of * 6 + _CODE[data], minlength=6 * n).reshape(n, 6)
    starts, ends, rows = V.words(data, bounds, V.WHITE)
    count = V.row_counts(rows, n).astype(float)
    words = np.maximum(count, 1)
    length = (ends - starts).astype(float)
    mean = _per_row(length, rows, n) / words
    spread = np.sqrt(np.maximum(_per_row(length**2, rows, n) / words - mean**2, 0))
    codes = V.word_hashes(V.LOWER[data], starts, ends)
    order = np.lexsort((codes, rows))
    a, r = codes[order], rows[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(first)
    runs = np.diff(np.append(at, len(a)))
    top = np.zeros(n)
    np.maximum.at(top, r[at], runs)
    next_same = rows[1:] == rows[:-1] if len(rows) else np.zeros(0, bool)
    again = _per_row((codes[1:] == codes[:-1]) & next_same, rows[1:], n) if len(rows) > 1 else np.zeros(n)
    pairs, pair_rows = V.distinct_in_rows((codes[:-1] * np.uint64(3) ^ codes[1:])[next_same], rows[:-1][next_same]) if len(rows) > 1 else (codes[:0], rows[:0])
    distinct_pairs = V.row_counts(pair_rows, n) / np.maximum(count - 1, 1)
    ls, le, lr = V.words(data, bounds, V.NEWLINE)
    lines = np.maximum(V.row_counts(lr, n), 1).astype(float)
    line_codes = V.word_hashes(data, ls, le)
    order = np.lexsort((line_codes, lr))
    line_codes, line_rows = line_codes[order], lr[order]
    new_line = np.ones(len(line_codes), bool)
    new_line[1:] = (line_codes[1:] != line_codes[:-1]) | (line_rows[1:] != line_rows[:-1])
    line_at = np.flatnonzero(new_line)
    line_runs = np.diff(np.append(line_at, len(line_codes)))
    in_repeats = _per_row(line_runs * (line_runs > 1), line_rows[line_at], n)
    seen = np.zeros((n, 256), bool)
    seen[row_of, data] = True
    ended = np.isin(data[ends - 1], np.frombuffer(b".!?", np.uint8)) if len(ends) else np.zeros(0, bool)
    columns = [
        np.log1p(size), np.log1p(count), *(kinds[:, 1:5] / some[:, None]).T, kinds[:, 0] / some, kinds[:, 5] / some, mean, spread,
        V.row_counts(r[at], n) / words, again / words, np.log1p(lines), V.row_counts(line_rows[line_at], n) / lines,
        in_repeats / lines, np.log1p(count / lines), distinct_pairs, _per_row(ended, rows, n) / words, np.log1p(seen.sum(1)), top / words,
    ]
    return np.stack(columns, 1)


def with_statistics(df: DataFrame, text: str = "text", keep: list[str] | None = None, out: str = "statistics") -> DataFrame:
    """``keep`` columns and an array of STATISTICS."""
    keep = [c for c in (df.columns if keep is None else keep) if c != out]
    schema = df.select(*keep).schema.add(out, T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = V.flat(batch.column(len(keep)))
            for i, j in V.portions(bounds):
                got = statistics(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                cuts = pa.array(np.arange(0, got.size + 1, got.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(i, j - i) for c in batch.columns[: len(keep)]), pa.ListArray.from_arrays(cuts, pa.array(got.ravel()))], names=[*keep, out]
                )

    return df.select(*keep, F.col(text).cast("binary").alias("__text__")).mapInArrow(lean(run), schema)


class Model:
    """Weights of the cosines and the steps of the calibration."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, prior: float):
        rng = np.random.default_rng(SEED)
        self.mean, self.deviation, self.prior = mean, np.where(deviation > 1e-9, deviation, 1.0), prior
        self.directions = rng.normal(0, 1 / (WIDTH * np.sqrt(len(mean))), (len(mean), FEATURES))
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights: np.ndarray | None = None
        self.edges, self.levels = np.zeros(1), np.array([prior])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.phases), np.ones((len(x), 1)), z])

    def raw(self, x: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        weights = self.weights if weights is None else weights
        return np.full(len(x), self.prior) if weights is None else self.features(x) @ weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return np.clip(np.interp(self.raw(x), self.edges, self.levels), 0.0, 1.0)


def rising(centres: np.ndarray, means: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the blocks' mean positions and levels, both rising."""
    blocks: list[list[float]] = []
    for c, m, n in zip(centres, means, counts, strict=True):
        blocks.append([c, m, n])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            c2, m2, n2 = blocks.pop()
            c1, m1, n1 = blocks[-1]
            blocks[-1] = [(c1 * n1 + c2 * n2) / (n1 + n2), (m1 * n1 + m2 * n2) / (n1 + n2), n1 + n2]
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


def _solve(gram: np.ndarray, moment: np.ndarray) -> np.ndarray:
    return np.linalg.solve(gram + RIDGE * np.eye(len(gram)), moment)


def fit(labelled: DataFrame, features: str = "statistics", label: str = "label", fold: str = "fold", prior: float = 0.5) -> Model:
    """Fits on rows of statistics, a label from 0 to 1 and a fold number; what reaches the driver has a fixed size."""
    width = len(STATISTICS)
    totals = [F.count("*"), F.avg(label)] + [f(F.col(features)[i]) for i in range(width) for f in (F.avg, F.stddev_pop)]
    row = labelled.agg(*totals).first()
    if not row[0]:
        return Model(np.zeros(width), np.ones(width), prior)
    model = Model(np.array(row[2::2]), np.array(row[3::2]), float(row[1]))
    size = FEATURES + 1 + width

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((FOLDS, size, size + 1))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten()).reshape(-1, width)
            y, f = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            phi = model.features(x)
            for k in range(FOLDS):
                a = phi[f == k]
                gram[k] += a.T @ np.hstack([a, y[f == k, None]])
        yield pa.RecordBatch.from_arrays([pa.array(range(FOLDS * BANDS), pa.int32()), pa.array([x.tobytes() for g in gram for x in np.array_split(g, BANDS)], pa.binary())], names=["band", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for band, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[band] = total.get(band, 0.0) + np.frombuffer(x.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["band", "sums"])

    # each partition sends its part of the equations in bands, and each band is added up by a task of its own
    spread = 2 * labelled.sparkSession.sparkContext.defaultParallelism
    parts = labelled.select(features, F.col(label).cast("double"), F.col(fold).cast("int")).coalesce(spread).mapInArrow(lean(partial), "band int, sums binary")
    bands = {r.band: np.frombuffer(r.sums) for r in parts.repartition(FOLDS * BANDS, "band").mapInArrow(lean(added), "band int, sums binary").collect()}
    gram = np.concatenate([bands[k] for k in range(FOLDS * BANDS)]).reshape(FOLDS, size, size + 1)
    whole = gram.sum(0)
    model.weights = _solve(whole[:, :-1], whole[:, -1])
    apart = np.stack([_solve(whole[:, :-1] - g[:, :-1], whole[:, -1] - g[:, -1]) for g in gram])

    def out_of_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(0).flatten()).reshape(-1, width)
            phi, f = model.features(x), np.asarray(batch.column(2))
            yield pa.RecordBatch.from_arrays([pa.array((phi * apart[f]).sum(1)), batch.column(1)], names=["raw", "label"])

    scored = labelled.select(features, F.col(label).cast("double"), F.col(fold).cast("int")).mapInArrow(lean(out_of_fold), "raw double, label double")
    bins = scored.groupBy(F.round(F.greatest(F.lit(-2.0), F.least(F.lit(3.0), "raw")), 3).alias("bin")).agg(F.avg("raw"), F.avg("label"), F.count("*")).orderBy("bin").collect()
    model.edges, model.levels = rising(*(np.array([b[i] for b in bins], float) for i in (1, 2, 3)))
    return model


def scored(df: DataFrame, model: Model, features: str = "statistics", out: str = "score") -> DataFrame:
    """Replaces the statistics by the score."""
    keep = [c for c in df.columns if c not in (features, out)]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(len(keep)).flatten()).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(shared.value.score(x))], names=[*keep, out])

    return df.select(*keep, features).mapInArrow(lean(run), df.select(*keep).schema.add(out, T.DoubleType()))


def learned(stats: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", label: str = "quality") -> Model:
    """Fits on the statistics of the rows with labels where ``learn`` holds of the label."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & learn).groupBy(key).agg(F.avg(label).alias("label"))
    return fit(stats.select(key, "statistics").join(known, key).select("statistics", "label", F.pmod(F.xxhash64(key), F.lit(FOLDS)).cast("int").alias("fold")))


def classify(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "quality", out: str = "score") -> DataFrame:
    """The key and the score of every text."""
    stats = written(with_statistics(docs, text, [key]), "statistics")
    return scored(stats, learned(stats, labels, learn, key, label), out=out)


def accepted(
    docs: DataFrame, labels: DataFrame, learn: Column, least: float, key: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """The rows of ``docs`` whose texts score ``least`` or more; their statistics are made anew, so no text is stored."""
    model = learned(written(with_statistics(docs, text, [key]), "statistics"), labels, learn, key, label)
    own = [f"__c{i}__" for i in range(len(docs.columns))]  # columns keep their names, whatever they are
    every = with_statistics(docs.toDF(*own), own[docs.columns.index(text)], own, out="__statistics__")
    kept = scored(every, model, "__statistics__", "__score__").where(F.col("__score__") >= least)
    return kept.select(*[F.col(o).alias(c) for o, c in zip(own, docs.columns, strict=True)])
