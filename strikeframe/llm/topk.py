"""Exact top-k by inner product: every query against every row.

Rows and queries are dealt into parts of bounded size; each pair of a query part and a row part is one group, which
accumulates scores term at a time: for each dimension, the postings of the rows that are not zero there are
weighted by the queries that are not zero there and added to a dense array of scores. The best k of each part are
selected, and a window over the queries merges them.

Defined results: vectors that are null or hold nulls or values that are not finite take no part, nor do null ids;
vectors of different length agree as if padded by zeros; ties go to the smaller id; rows with the query's own id
are no candidates; repeated rows are candidates each; products beyond 64 bits are ranked exactly and shown as the
nearest 64-bit integer; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows and queries in a part; a group holds a part of each.
ROWS_AT_ONCE, QUERIES_AT_ONCE = 8192, 1024
#: Queries whose scores are held at a time.
DENSE_QUERIES = 128


def floored(embedding: str, scale: float = 256.0) -> Column:
    """Each component as floor(scale * x), x as double."""
    return F.transform(F.col(embedding), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def usable(embedding: str) -> Column:
    finite = F.forall(F.col(embedding), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(embedding).isNotNull() & finite


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths(), dtype=np.int64)
    out = np.zeros((len(column), width), np.int64)
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.asarray(column.flatten())
    return out


def _scores(queries: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Dense scores of all rows for some queries, a term at a time."""
    scores = np.zeros((len(queries), n), queries.dtype)
    for term, (rows, weights) in enumerate(postings):
        ours = np.flatnonzero(queries[:, term])
        if not len(ours) or not len(rows):
            continue
        added = queries[ours, term][:, None] * weights[None, :]
        if len(ours) == len(queries) and len(rows) == n:
            scores += added
        elif len(rows) == n:
            scores[ours] += added
        else:
            scores[np.ix_(ours, rows)] += added
    return scores


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[list, list, list]:
    """The best k rows of each query within a part: lists of query ids, row ids and scores."""
    out: tuple[list, list, list] = ([], [], [])
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    top_q = np.abs(queries.astype(float)).max(0, initial=0)
    top_v = np.abs(vectors.astype(float)).max(0, initial=0)
    if float(top_q @ top_v) >= 2.0**62:  # Python's integers know no overflow
        queries, vectors = queries.astype(object), vectors.astype(object)
    postings = [(rows := np.flatnonzero(vectors[:, t]), vectors[rows, t]) for t in range(vectors.shape[1])]
    for begin in range(0, len(queries), DENSE_QUERIES):
        scores = _scores(queries[begin : begin + DENSE_QUERIES], postings, len(ids))
        for row, q in zip(scores, query_ids[begin : begin + DENSE_QUERIES], strict=True):
            m = min(len(row), k + int(np.searchsorted(ids, q, "right") - np.searchsorted(ids, q)))
            if not m:
                continue
            least = np.partition(row, len(row) - m)[len(row) - m]
            at = np.flatnonzero(row >= least)
            at = at[ids[at] != q]
            at = at[np.argsort(-row[at], kind="stable")][:k]  # at is in order of ids
            out[0].extend([int(q)] * len(at))
            out[1].extend(ids[at].tolist())
            out[2].extend(min(max(int(x), -(2**63)), 2**63 - 1) for x in row[at])
    return out


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "vector", rows_at_once: int = ROWS_AT_ONCE, queries_at_once: int = QUERIES_AT_ONCE
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score; both frames hold ids and arrays of integers."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    asked = queries.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    counts = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    row_parts = max(1, -(-counts[0] // rows_at_once))
    n_asked = asked.count()
    query_parts = max(1, -(-n_asked // queries_at_once))
    width = max(1, counts[1] or 0)
    rows = rows.withColumn("p", F.pmod(F.xxhash64("id", "v"), F.lit(row_parts)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))))
    asked = asked.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(query_parts)).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(row_parts - 1))))

    def part(left: pa.Table, right: pa.Table) -> pa.Table:
        size = max(width, *(int(np.max(np.asarray(t["v"].combine_chunks().value_lengths()), initial=0)) for t in (left, right)))
        got = best(np.asarray(left["id"]), _matrix(left["v"], size), np.asarray(right["id"]), _matrix(right["v"], size), k)
        return pa.table([pa.array(x, pa.int64()) for x in got], names=["query_id", "vec_id", "score"])

    found = asked.groupBy("p", "b").cogroup(rows.groupBy("p", "b")).applyInArrow(part, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
