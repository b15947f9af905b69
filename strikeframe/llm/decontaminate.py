"""Benchmark decontamination with one Aho-Corasick automaton.

Words are the maximal runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. A window is
``width`` consecutive words of an item (a shorter item is one window). The automaton holds the items' aligned
segments of ceil(width / 2) words: every window contains one, so scanning a text once finds every place where a
window can be, and comparing words to both sides finds how far the text and the item agree. A segment that many items
share is compared with each of them. Word positions map to character offsets of the original text.

A worker builds the automaton from the broadcast texts, in about 50 bytes of memory for each byte of them. A benchmark
of more than ``most_bytes`` is dealt into parts of about so many bytes, by the items' ids; each part has an automaton
and a pass over the texts of its own, and the hits of a text, by its digest, are put together afterwards. The result
is the same: no window is longer than its item. (Only a single item of more bytes than that makes a larger part.)

Defined results: null texts and texts without words have no words and no hits; an empty benchmark hits nothing;
repeated rows are judged alike; items with the same id count once; columns named like an output are replaced (``clean``
keeps the input's columns, whatever their names); texts are scanned whole.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeframe.llm import textvec as V
from strikeframe.llm.common import lean, small_batches, written

WIDTH = 13
#: Bytes of benchmark texts that a worker's memory is taken to allow.
MOST_BYTES = 64_000_000

_CLEAN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

_SEPARATOR = np.array([c == 0x20 for c in _CLEAN])

RANGES = T.ArrayType(T.ArrayType(T.IntegerType()))
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_CLEAN).split()


class Items:
    """The benchmark as an automaton."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        import ahocorasick

        self.width, self.half = width, (width + 1) // 2
        self.ids = [i for i, _ in items]
        self.words = [normal_words(t) for _, t in items]
        places = defaultdict(list)
        for k, words in enumerate(self.words):
            step = self.half if len(words) >= width else len(words)
            if step:
                for j in range(0, len(words) - step + 1, step):
                    places[b" ".join(words[j : j + step])].append((k, j))
        self.automaton = ahocorasick.Automaton()
        for key, at in places.items():
            self.automaton.add_word(f" {key.decode('latin-1')} ", (key.count(b" ") + 1, at))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Ranges of document words inside windows, and the ids of the items they come from."""
        if self.empty or not words:
            return [], set()
        text = f" {b' '.join(words).decode('latin-1')} "
        ranges, found, done, ends = [], set(), {}, None
        for last, (length, at) in self.automaton.iter(text):
            if ends is None:  # where each word ends, for texts with a match only
                ends = np.cumsum([len(w) + 1 for w in words])
            i = int(np.searchsorted(ends, last)) - length + 1
            for k, j in at:
                item = self.words[k]
                if done.get((k, i - j), 0) > i:
                    continue
                a, b = 0, length
                while i - a > 0 and j - a > 0 and words[i - a - 1] == item[j - a - 1]:
                    a += 1
                while i + b < len(words) and j + b < len(item) and words[i + b] == item[j + b]:
                    b += 1
                done[k, i - j] = i + b
                if a + b >= min(self.width, len(item)):
                    ranges.append((i - a, i + b))
                    found.add(self.ids[k])
        return ranges, found


def joined(ranges: list[tuple[int, int]]) -> list[list[int]]:
    """The union of ranges, in order and apart."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_ITEMS: dict[str, Items] = {}


def _items(shared: Broadcast, width: int) -> Items:
    """The worker's own automaton, made once; only the latest benchmark's is kept."""
    name, items = shared.value
    if name not in _ITEMS:
        _ITEMS.clear()
        _ITEMS[name] = Items(items, width)
    return _ITEMS[name]


def character_spans(text: bytes, ranges: list[list[int]]) -> list[dict[str, int]]:
    """Ranges of words as start and end in characters of the text."""
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = V.words(data, np.array([0, len(data)]), _SEPARATOR)
    character = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    return [{"start": int(character[starts[a]]), "end": int(character[ends[b - 1]])} for a, b in ranges]


def find_items(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, most_bytes: int = MOST_BYTES, spans: str | None = None
) -> DataFrame:
    """Adds n_words, hit_ranges (pairs of word positions, the end excluded), item_ids (sorted as strings) and, if named,
    ``spans`` (the ranges as start and end in characters of the original text)."""
    outputs = ["n_words", "hit_ranges", "item_ids", *([spans] if spans else [])]
    small_batches(docs.sparkSession)
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(item_text).cast("binary").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > most_bytes:
        return _in_parts(docs, items, -(-size // most_bytes), text, width, spans)
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(r.id, bytes(r.text)) for r in items.collect()]))
    return _scanned(docs, shared, text, width, spans)


def _in_parts(docs: DataFrame, items: DataFrame, parts: int, text: str, width: int, spans: str | None) -> DataFrame:
    """``find_items`` with an automaton for each part of the items; texts with the same digest are the same."""
    outputs = ["n_words", "hit_ranges", "item_ids", *([spans] if spans else [])]
    dealt = written(items.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")), "benchmark-parts")
    digest = F.sha2(F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")), 256)
    texts = docs.select(digest.alias("digest"), F.col(f"`{text}`").alias("text"))
    found = None
    for part in range(parts):
        shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(r.id, bytes(r.text)) for r in dealt.where(F.col("part") == part).collect()]))
        hits = _scanned(texts, shared, "text", width, "spans" if spans else None).where(F.size("item_ids") > 0).drop("text", "n_words").dropDuplicates(["digest"])
        hits = written(hits, "benchmark-hits")
        shared.unpersist()
        found = hits if found is None else found.unionByName(hits)
    both = found.groupBy("digest").agg(F.flatten(F.collect_list("hit_ranges")).alias("hit_ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    kept = [c for c in docs.columns if c not in outputs]
    none = docs.sparkSession.sparkContext.broadcast(("none", []))
    rows = _scanned(docs.select(*[F.col(f"`{c}`") for c in kept], digest.alias("__digest__"), F.col(f"`{text}`").alias("__scanned__")), none, "__scanned__", width, None).drop("hit_ranges", "item_ids")
    rows = rows.join(both.withColumnRenamed("digest", "__digest__"), "__digest__", "left")
    ranges = F.coalesce("hit_ranges", F.array().cast("array<array<int>>"))
    out = rows.withColumns({"hit_ranges": _union(ranges), "item_ids": F.coalesce("item_ids", F.array().cast("array<string>"))})
    if spans:
        out = _with_spans(out, "__scanned__", "hit_ranges", spans)
    return out.select(*[F.col(f"`{c}`") for c in kept], *outputs)


def _union(ranges: Column) -> Column:
    """``joined`` for a column of ranges."""
    def add(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        apart = (F.size(done) == 0) | (r[0] > F.coalesce(F.get(last, F.lit(1)), F.lit(-1)))
        return F.when(apart, F.concat(done, F.array(r))).otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.array(last[0], F.greatest(last[1], r[1])))))

    return F.aggregate(F.array_sort(ranges), F.array().cast("array<array<int>>"), add)


def _with_spans(df: DataFrame, text: str, ranges: str, out: str) -> DataFrame:
    """Adds ranges of words as start and end in characters of the text."""
    kept = [c for c in df.columns if c != out]
    own = [f"__k{i}__" for i in range(len(kept))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist()
            places = [character_spans(t or b"", r) if r else [] for t, r in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(places, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=[*own, out])

    rows = df.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(kept, own, strict=True)], F.col(text).cast("binary").alias("__text__"), F.col(ranges).alias("__ranges__"))
    found = rows.mapInArrow(lean(run), rows.select(*own).schema.add(out, SPANS))
    return found.select(*[F.col(o).alias(c) for c, o in zip(kept, own, strict=True)], out)


def _scanned(docs: DataFrame, shared: Broadcast, text: str, width: int, spans: str | None) -> DataFrame:
    """``find_items`` with the automaton of the broadcast items."""
    outputs = ["n_words", "hit_ranges", "item_ids", *([spans] if spans else [])]
    kept = [c for c in docs.columns if c not in outputs]
    names = [f"__k{i}__" for i in range(len(kept))]  # a name with a dot would be taken for a field's
    schema = T.StructType([T.StructField(o, docs.schema[c].dataType) for c, o in zip(kept, names, strict=True)] + [T.StructField("n_words", T.LongType()), T.StructField("hit_ranges", RANGES), T.StructField("item_ids", T.ArrayType(T.StringType()))])
    if spans:
        schema = schema.add(spans, SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _items(shared, width)
        for batch in batches:
            n, ranges, ids, places = [], [], [], []
            for t in batch.column(len(kept)):
                data = t.as_py() or b""
                words = normal_words(data)
                at, found = own.find(words)
                n.append(len(words))
                ranges.append(joined(at))
                ids.append(sorted(found))
                if spans:
                    places.append(character_spans(data, ranges[-1]) if at else [])
            new = [pa.array(n, pa.int64()), pa.array(ranges, pa.list_(pa.list_(pa.int32()))), pa.array(ids, pa.list_(pa.string()))]
            if spans:
                new.append(pa.array(places, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *new], names=[*names, *outputs])

    source = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(kept, names, strict=True)], F.col(f"`{text}`").cast("binary").alias("__text__"))
    return source.mapInArrow(lean(run), schema).select(*[F.col(o).alias(c) for c, o in zip(kept, names, strict=True)], *outputs)


def n_hit(ranges: str = "hit_ranges") -> Column:
    return F.aggregate(F.col(ranges), F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])


def contaminated(hit: Column | None = None, n_words: str = "n_words") -> Column:
    """A twentieth of the words or more are inside windows."""
    hit = n_hit() if hit is None else hit
    return (hit > 0) & (20 * hit >= F.col(n_words))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns, whatever their names."""
    own = [f"__c{i}__" for i in range(len(docs.columns))]
    text = own[docs.columns.index(options.pop("text", "text"))]
    found = find_items(docs.toDF(*own), benchmark, text=text, **options).where(~contaminated())
    return found.select(*[F.col(o).alias(c) for o, c in zip(own, docs.columns, strict=True)])
