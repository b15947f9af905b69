"""Substring dedup by content-defined chunking with a gear rolling hash.

The gear hash of a position adds a code for each of the last 32 bytes, shifted by their distance. A chunk ends where
the hash is below a threshold and no such place lies within the last ``SHORTEST`` bytes, so ends depend on nearby
bytes only: after an insertion the next ends are where they were. A chunk of more than ``LONGEST`` bytes is cut where
its hash is least, which finds the periods of repetitive text, and after ``LONGEST`` bytes at the latest.

Chunks are compared by a 128-bit digest. The first chunk of a digest (by id and position) stays; runs of later ones
that cover ``LEAST_RUN`` bytes or more are repeated passages.

Defined results: null and empty texts have no chunks; rows without an id take no part; rows that share id and text
count as one document; ties can't be, since id and position order chunks; an empty table gives no rows; extra
columns are ignored by ``repeats`` and kept by ``without_repeats``; long texts are cut and compared whole; ``repeats``
lists the passages of different texts of one id together, ``without_repeats`` tells such texts apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeframe.llm import textvec as V
from strikeframe.llm.common import has, membership, written

ONE_IN, SHORTEST, LONGEST = 24, 12, 256
WINDOW = 32
QUARTER = LONGEST // 4
LEAST_RUN = 72
GEAR = (V.mix(V.BYTE_CODES ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, over the last WINDOW bytes, by doubling the window."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        more = h.copy()
        more[width:] += h[:-width] << np.uint32(width)
        h, width = more, 2 * width
    return h


def _within(h: np.ndarray, start: int, end: int) -> np.ndarray:
    """Ends within a stretch that has none: where the hash is the stretch's least, such as once in each period of
    repetitive text, at least QUARTER apart."""
    inner = h[start + WINDOW - 1 : end - 1]
    at = np.flatnonzero(inner == inner.min()) + start + WINDOW
    kept, last = [], -QUARTER
    while (k := int(np.searchsorted(at, last + QUARTER))) < len(at):
        last = int(at[k])
        kept.append(last)
    return np.array(kept, np.int64)


def chunks(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of all chunks; rows are cut apart and covered whole."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    h = gear(data)
    at = np.flatnonzero(h < np.uint32(2**32 // ONE_IN)) + 1
    row = np.searchsorted(bounds, at - 1, "right") - 1
    inside = at - bounds[row] >= WINDOW  # the window lies within the row
    at, row = at[inside], row[inside]
    apart = np.ones(len(at), bool)
    apart[1:] = (np.diff(at) >= SHORTEST) | (row[1:] != row[:-1])
    ends = np.union1d(at[apart], bounds[1:][np.diff(bounds) > 0])
    starts = np.concatenate([[0], ends[:-1]])
    long = np.flatnonzero(ends - starts > LONGEST)
    ends = np.union1d(ends, np.concatenate([_within(h, a, b) for a, b in zip(starts[long], ends[long], strict=True)] or [ends[:0]]))
    starts = np.concatenate([[0], ends[:-1]])
    extra = (ends - starts - 1) // LONGEST
    if extra.any():
        nth = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        ends = np.union1d(ends, np.repeat(starts, extra) + nth * LONGEST)
        starts = np.concatenate([[0], ends[:-1]])
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def _version(text: str) -> Column:
    """Tells different texts of one id apart."""
    return F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")))


def chunk_table(docs: DataFrame, key: str = "doc_id", text: str = "text", only: Broadcast | None = None, versions: bool = False) -> DataFrame:
    """doc_id, start, size, and the digest in two halves, of every chunk; of those in ``only``, if it is given.

    With ``versions`` there is also the text's ``version``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            data, bounds = V.flat(batch.column(1))
            for i, j in V.portions(bounds):
                part, inner = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
                starts, ends, rows = chunks(part, inner)
                high = V.word_hashes(part, starts, ends).view(np.int64)
                low = V.word_hashes(part, starts, ends, V.MORE_CODES, V.MORE_BASE).view(np.int64)
                columns = [ids[i:j][rows], (starts - inner[rows]).astype(np.int32), (ends - starts).astype(np.int32), high, low]
                columns += [np.asarray(batch.column(2))[i:j][rows]] if versions else []
                if only is not None:
                    keep = has(only, high)
                    columns = [c[keep] for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "start", "size", "high", "low", *more])

    more = ["version"] if versions else []
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"), *[_version(text).alias(v) for v in more]).where("doc_id is not null")
    return source.mapInArrow(run, "doc_id long, start int, size int, high long, low long" + (", version long" if versions else ""))


def repeated_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", versions: bool = False) -> DataFrame:
    """doc_id (and version), start and size of the chunks that come again, and source_id and source_start of their first."""
    whole = ["doc_id", *(["version"] if versions else [])]
    every = chunk_table(docs, key, text, versions=versions)
    groups = every.groupBy("high", "low").agg(F.count("*").alias("n"), F.min(F.struct(*whole, "start")).alias("first"))
    groups = written(groups.where("n > 1").select("high", "low", "first"), "chunks")
    again = chunk_table(docs, key, text, membership(groups.select("high")), versions)
    found = again.join(groups, ["high", "low"]).where(F.struct(*whole, "start") != F.col("first"))
    return found.select(*whole, "start", "size", F.col("first.doc_id").alias("source_id"), F.col("first.start").alias("source_start"))


def runs(repeated: DataFrame, least: int = LEAST_RUN) -> DataFrame:
    """doc_id and its repeated passages: array of start, end (bytes, the end excluded) and source_ids, in order."""
    whole = [c for c in ("doc_id", "version") if c in repeated.columns]
    found = repeated.groupBy(*whole).agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end"), "source_id"))).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                passages: list[dict] = []
                for x in row["found"]:
                    if passages and passages[-1]["end"] == x["start"]:
                        passages[-1]["end"] = x["end"]
                        passages[-1]["source_ids"].append(x["source_id"])
                    else:
                        passages.append({"start": x["start"], "end": x["end"], "source_ids": [x["source_id"]]})
                passages = [p | {"source_ids": sorted({*p["source_ids"]})} for p in passages if p["end"] - p["start"] >= least]
                if passages:
                    out.append({c: row[c] for c in whole} | {"passages": passages})
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source_ids", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_pylist(out, pa.schema([*((c, pa.int64()) for c in whole), ("passages", kind)]))

    return found.mapInArrow(run, ", ".join(f"{c} long" for c in whole) + ", passages array<struct<start:int,end:int,source_ids:array<bigint>>>")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_RUN) -> DataFrame:
    """doc_id and passages of every document that repeats another (or itself)."""
    return runs(repeated_chunks(docs, key, text), least)


def left_over(text: bytes, passages: list[dict]) -> bytes:
    """The text without its passages; a character that a passage's edge cuts is kept."""
    inside = lambda at: at < len(text) and text[at] & 0xC0 == 0x80
    out, done = [], 0
    for p in passages:
        start, end = p["start"], p["end"]
        while inside(start):
            start += 1
        while inside(end):
            end -= 1
        if start < end:
            out.append(text[done:start])
            done = end
    return b"".join([*out, text[done:]])


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "kept_text", least: int = LEAST_RUN) -> DataFrame:
    """``docs`` with the text that is left without its repeated passages, cut at whole characters.

    Rows of one id with different texts are documents of their own, the one with the smaller digest the first of them;
    rows of one id and text lose the same passages.
    """
    found = runs(repeated_chunks(docs, key, text, versions=True), least)
    passages = found.select(F.col("doc_id").alias("__key__"), F.col("version").alias("__version__"), F.col("passages").alias("__passages__"))
    kept = [c for c in docs.columns if c != out]
    df = docs.select(*[F.col(f"`{c}`") for c in kept]).join(passages, (F.col(f"`{key}`").cast("long") == F.col("__key__")) & (_version(text) == F.col("__version__")), "left")
    df = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text__"), "__passages__")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column(len(kept)).cast(pa.binary()).to_pylist(), batch.column(len(kept) + 1).to_pylist()
            left = [left_over(t, p) if t is not None and p else t for t, p in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(left, pa.binary()).cast(pa.string())], names=[*kept, out])

    return df.mapInArrow(run, df.select(*[F.col(f"`{c}`") for c in kept]).schema.add(out, "string"))
