"""Hard negatives by norm-bucketed search: for each anchor and positive, the best rows of other labels within a window.

Rows are put in order of their norm, longest first, and dealt into stretches of about ``STRETCH`` rows; a stretch is
searched in buckets of ``BUCKET`` rows. By Cauchy-Schwarz no row of a bucket scores more than the anchor's norm times
the bucket's longest; a bucket is passed over where that is below every window's lower limit or below its running
k-th score, and the rest of the stretch as well once that holds for all anchors of a block. Blocks are made of
anchors that need rows of like norms, and a stretch too short for all anchors of a block is never sent to it. The
first search, for an anchor's positives, has one window without limits; the second has one for each positive. The
best of each stretch are merged by a window function.

Defined results: rows with a null id, label or vector, or with null or non-finite components, take no part; vectors
of different length agree as if padded by zeros; ties go to the smaller id; an anchor's own id is never its positive;
repeated rows are candidates each; of several anchor rows of one id the one with the smallest label and vector asks;
a positive that comes twice has its negatives twice; anchors without positives and positives without negatives give no
rows; products are exact, beyond 64 bits too, where they are shown as the nearest 64-bit integer; empty tables give
no rows; the vectors of one table have a bounded length; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikeframe.llm.common import discard, written
from strikeframe.llm.topk import _matrix

#: Rows in a stretch (about) and in a bucket, anchors in a block (about), anchors whose scores are held at a time.
STRETCH, BUCKET, BLOCK, DENSE = 16384, 1024, 4096, 128
#: Norms are rounded; bounds are raised by this share of themselves.
SLACK = 1e-9
#: Up to this bound all sums and their hundredfold are whole numbers in doubles.
DOUBLES = 2.0**46


def norm(vector: str) -> Column:
    return F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def _first(keys: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the first k of their key: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -scores, keys)) if scores.dtype != object else np.array(sorted(range(len(keys)), key=lambda i: (keys[i], -scores[i], ids[i])), np.int64)
    sorted_keys = keys[order]
    begin = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(order) else np.zeros(0, np.int64)
    place = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order[place < k]


class Anchors:
    """Anchors of a block, with the windows that each asks for: rows of scores from low to high."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.ids, self.labels, self.vectors, self.low, self.high = ids, labels, vectors, low, high
        self.norms = np.sqrt((vectors.astype(float) ** 2).sum(1))


def searched(asked: Anchors, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, window, row and score of each window's best k rows, with the anchor's label or with another.

    Windows hold whole numbers; NaN is a window that an anchor doesn't have.
    """
    norms = np.sqrt((vectors.astype(float) ** 2).sum(1))
    order = np.argsort(-norms, kind="stable")
    ids, labels, vectors, norms = ids[order], labels[order], vectors[order], norms[order]
    widest = float(asked.norms.max(initial=0)) * float(norms.max(initial=0))
    kind = float if widest < DOUBLES else object  # Python's integers know no overflow
    vectors = vectors.astype(kind)
    windows = asked.low.shape[1]
    found: list[tuple[np.ndarray, ...]] = []
    for start in range(0, len(asked.ids), DENSE):
        some = slice(start, start + DENSE)
        own, who, mine = asked.vectors[some].astype(kind), asked.ids[some], asked.labels[some]
        low, high = asked.low[some], asked.high[some]
        kth = np.full(low.shape, -np.inf, object if kind is object else float)
        keys, scores, rows = np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, np.int64)
        for at in range(0, len(ids), BUCKET):
            part = slice(at, at + BUCKET)
            bound = asked.norms[some] * norms[at] * (1 + SLACK) + 1
            live = (bound[:, None] >= low.astype(float) * (1 - SLACK * np.sign(low.astype(float)))) & (bound[:, None] >= kth.astype(float) * (1 - SLACK * np.sign(np.nan_to_num(kth.astype(float)))))
            use = np.flatnonzero(live.any(1))
            if not len(use):
                break  # the rows that follow are shorter still
            dots = own[use] @ vectors[part].T
            allowed = labels[part][None, :] == mine[use][:, None]
            allowed = allowed & (ids[part][None, :] != who[use][:, None]) if same else ~allowed
            for j in range(windows):
                here = allowed & (dots >= np.where(kth[use, j] > low[use, j], kth[use, j], low[use, j])[:, None]) & (dots <= high[use, j][:, None]) & live[use, j][:, None]
                a, c = np.nonzero(here)
                if not len(a):
                    continue
                new_scores, new_keys, new_rows = dots[a, c], use[a] * windows + j, ids[part][c]
                again = keys % windows == j
                all_keys, all_scores, all_rows = (np.concatenate(x) for x in ((keys[again], new_keys), (scores[again], new_scores), (rows[again], new_rows)))
                best = _first(all_keys, all_scores, all_rows, k)
                best_keys, best_scores = all_keys[best], all_scores[best]
                full, first, number = np.unique(best_keys, return_index=True, return_counts=True)
                reached = number == k
                kth[full[reached] // windows, j] = best_scores[(first + number - 1)[reached]]
                keys, scores, rows = (np.concatenate((x[~again], y)) for x, y in ((keys, best_keys), (scores, best_scores), (rows, all_rows[best])))
        found.append((who[keys // windows], keys % windows, rows, scores))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _parts(dealt: DataFrame, n: int, out: str) -> DataFrame:
    """Numbers below n for neighbouring partitions, of which there may be more or fewer than were asked for."""
    parts = (dealt.agg(F.max("part")).first()[0] or 0) + 1
    return dealt.withColumn(out, F.floor(F.col("part") * n / parts).cast("int")).drop("part")


def _pairs(anchors: DataFrame, rows: DataFrame, n_blocks: int, width: int, k: int, same: bool, score_type: str, windows_of: Callable) -> DataFrame:
    """Every block of anchors with every stretch that is long enough for it: id, window, row and score."""
    dealt = _parts(written(anchors.repartitionByRange(n_blocks, "need", "id").withColumn("part", F.spark_partition_id()), "negatives-anchors"), n_blocks, "block")
    blocks = dealt.groupBy("block").agg(F.min("need").alias("need"))
    stretches = rows.groupBy("stretch").agg(F.max("norm").alias("longest"))
    meet = F.col("longest") * (1 + SLACK) >= F.col("need")
    last = blocks.agg(F.max("block")).first()[0] or 0
    met = stretches.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(last)))).join(blocks, "block").where(meet).select("stretch", "block")
    left = dealt.drop("need").join(met, "block").withColumns({"my_block": F.col("block") + 0, "my_stretch": F.col("stretch") + 0}).drop("block", "stretch")
    right = rows.select("id", "label", "v", "stretch").join(met, "stretch")
    decimals = score_type != "long"

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        low, high = windows_of(a)
        asked = Anchors(np.asarray(a["id"]), np.asarray(a["label"]), _matrix(a["v"], width), low, high)
        who, window, row, score = searched(asked, np.asarray(b["id"]), np.asarray(b["label"]), _matrix(b["v"], width), k, same)
        shown = pa.array([Decimal(max(min(int(x), 10**38 - 1), 1 - 10**38)) for x in score], pa.decimal128(38, 0)) if decimals else pa.array(score.astype(np.int64))
        return pa.table([pa.array(who, pa.int64()), pa.array(window.astype(np.int32)), pa.array(row, pa.int64()), shown], names=["id", "window", "row", "score"])

    return left.groupBy("my_block", "my_stretch").cogroup(right.groupBy("block", "stretch")).applyInArrow(run, f"id long, window int, row long, score {score_type}")


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id", "window").orderBy(F.desc("score"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, vec_id: str = "vec_id", label: str = "label", vector: str = "vector"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score (see the module).

    Both frames hold ids, labels and arrays of integers; a negative's score is from ``low`` to ``high`` hundredths of
    its positive's.
    """
    columns = [F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v")]
    known = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    scratch: list[str] = []
    numbered = vectors.select(*columns).where(known).withColumn("norm", norm("v")).withColumn("nonce", F.monotonically_increasing_id())
    size = numbered.agg(F.count("*"), F.max(F.size("v")), F.max("norm")).first()
    n_stretches = max(1, -(-size[0] // STRETCH))
    width = max(1, size[1] or 0)
    # equal norms are told apart by the nonce, so that a stretch has a bounded number of rows whatever repeats
    rows = _parts(written(numbered.repartitionByRange(n_stretches, F.desc("norm"), "nonce").withColumn("part", F.spark_partition_id()).drop("nonce"), "negatives-rows", scratch), n_stretches, "stretch")
    asked = anchors.select(*columns).where(known).groupBy("id").agg(F.min(F.struct("label", "v")).alias("a")).select("id", "a.*").withColumn("norm", norm("v"))
    asked = written(asked, "negatives-asked", scratch)
    top = asked.agg(F.count("*"), F.max("norm"), F.max(F.size("v"))).first()
    n_blocks = max(1, -(-top[0] // BLOCK))
    width = max(width, top[2] or 0)
    score_type = "long" if (size[2] or 0.0) * (top[1] or 0.0) < 2.0**62 else "decimal(38,0)"

    def anything(a: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return np.full((len(a), 1), -np.inf), np.full((len(a), 1), np.inf)

    like = _merged(_pairs(asked.select("id", "label", "v", F.lit(float("-inf")).alias("need")), rows, n_blocks, width, positives, True, score_type, anything), positives)
    like = like.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "row", "score"))).alias("like"))  # no more than ``positives`` each
    like = written(like, "negatives-positives", scratch)

    def limits(a: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        scores = [[int(s) for s in x] for x in a["scores"].to_pylist()]
        bounds = [[(-(-low * s // 100), high * s // 100) for s in x] + [(np.nan, np.nan)] * (positives - len(x)) for x in scores]
        exact = object if decimals else float
        found = np.empty((len(bounds), positives, 2), exact)
        for i, b in enumerate(bounds):
            found[i] = b
        return found[:, :, 0], found[:, :, 1]

    decimals = score_type != "long" or (size[2] or 0.0) * (top[1] or 0.0) >= DOUBLES
    lowest = F.array_min("scores").cast("double") * low / 100
    need = F.when((lowest <= 0) | (F.col("norm") == 0), F.lit(float("-inf"))).otherwise(lowest / F.col("norm") * (1 - SLACK) - F.try_divide(F.lit(2.0), F.col("norm")))
    again = asked.join(like.select("id", F.col("like.score").alias("scores")), "id").select("id", "label", "v", "scores", need.alias("need"))
    unlike = _merged(_pairs(again, rows, n_blocks, width, negatives, False, score_type, limits), negatives)
    pairs = like.select("id", F.explode("like").alias("p")).select("id", (F.col("p.rank") - 1).alias("window"), F.col("p.row").alias("positive_id"), F.col("p.score").alias("positive_score"))

    def shown(c: str) -> Column:
        return F.greatest(F.least(F.col(c).cast("decimal(38,0)"), F.lit(Decimal(2**63 - 1))), F.lit(Decimal(-(2**63)))).cast("long") if score_type != "long" else F.col(c)

    out = pairs.join(unlike, ["id", "window"]).select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("row").alias("negative_id"), shown("positive_score").alias("positive_score"), shown("score").alias("negative_score")
    )
    out = written(out, "negatives")
    discard(vectors.sparkSession, scratch)
    return out
