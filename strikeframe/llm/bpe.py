"""Byte-level BPE: encoding and decoding of whole texts.

A rank file (base64 token, rank) becomes a model of the tokenizers library: token bytes are written in the
printable byte alphabet, and every split of a token into two known tokens becomes a merge of the token's rank,
which is how rank-based encoders merge. A text is cut by the pattern into pieces; pieces that a worker has not
met yet are encoded in one batch, and their ids are kept in a bounded table, since words repeat.

Defined results: a null or empty text has no tokens and decodes to no bytes; repeated rows and ties are encoded
alike; an empty table gives an empty table; columns named like an output are replaced; other columns stay.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeframe.llm.common import lean, trim

#: Pieces whose ids a worker keeps; beyond it the table starts anew.
PIECES_KEPT = 150_000
#: Characters of text whose tokens are held at a time.
TEXT_AT_ONCE = 300_000

OFFSETS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def byte_alphabet() -> list[str]:
    """The printable character of each byte: itself if it is visible Latin-1, else the next free one from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    pairs = (line.split() for line in data.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def merge_order(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Where the token splits into two known ones; of two splits that can overlap, the one further left first."""
    cuts = [i for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    n = len(token)
    late = {n - i for i in cuts if 2 * i != n and n - i in cuts and token[i:] == token[: n - i]}
    early = {i for i in cuts if n - i in late}
    return sorted(cuts, key=lambda i: ((i in late) - (i in early), i))


class ByteTable:
    """The bytes of every id, in the printable alphabet's reverse: all that decoding needs."""

    def __init__(self, data: bytes):
        alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(alphabet)}
        ranks = read_ranks(data)
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            table[i] = bytes(back[alphabet[b]] for b in token)
        self.lengths = np.array([len(t) for t in table], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for; they need not end at a character's end."""
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        length = self.lengths[at]
        ends = np.cumsum(length)
        if not len(ends):
            return b""
        return self.flat[np.repeat(self.starts[at] - ends + length, length) + np.arange(ends[-1])].tobytes()

    def offsets(self, ids: bytes) -> np.ndarray:
        """(start, end) in characters for each token; a character split over tokens belongs to each of them."""
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        ends = np.cumsum(self.lengths[at])
        if not len(ends):
            return np.zeros((0, 2), np.int64)
        begins = (np.frombuffer(self.decode(ids), np.uint8) & 0xC0) != 0x80
        character = np.cumsum(begins) - 1
        return np.stack([character[ends - self.lengths[at]], character[ends - 1] + 1], 1)


class Codec:
    """A vocabulary in the form that encoding needs."""

    def __init__(self, data: bytes, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(data)
        alphabet = byte_alphabet()
        mapped = {token: "".join(alphabet[b] for b in token) for token in ranks}
        merges = [(mapped[t[:i]], mapped[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in merge_order(t, ranks)]
        model = models.BPE(vocab={mapped[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        self.pieces = Tokenizer(model)
        self.pieces.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        cut = [self.find(x) for x in texts]
        new = {p for pieces in cut for p in pieces if p not in self.known}
        if len(self.known) + len(new) > PIECES_KEPT:
            self.known.clear()
            new = {p for pieces in cut for p in pieces}
        if new:
            order = list(new)
            for piece, e in zip(order, self.pieces.encode_batch_fast(order, add_special_tokens=False)):
                self.known[piece] = np.array(e.ids, "<u4").tobytes()
        known = self.known
        return [b"".join([known[p] for p in pieces]) for pieces in cut]


_CODECS: dict[tuple[str, str], Codec] = {}
_TABLES: dict[str, ByteTable] = {}


def codec(shared: Broadcast) -> Codec:
    """The worker's own codec, made once."""
    data, pattern = shared.value
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(data, pattern)
        trim()
    return _CODECS[key]


def byte_table(shared: Broadcast) -> ByteTable:
    """The worker's own table of bytes, made once."""
    data, _ = shared.value
    key = hashlib.sha256(data).hexdigest()
    if key not in _TABLES:
        _TABLES[key] = ByteTable(data)
    return _TABLES[key]


def vocabulary(df: DataFrame, path: str, pattern: str) -> Broadcast:
    """The rank file, read by the driver; a vocabulary has a fixed size, so it is sent to all executors."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast((f.read(), pattern))


def _slices(sizes: list[int], most: int) -> Iterator[slice]:
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def encode(df: DataFrame, shared: Broadcast, text: str = "text", ids: str = "ids", offsets: str | None = None) -> DataFrame:
    """Adds ``ids`` (binary: little-endian unsigned 32-bit) and, if named, ``offsets`` (array of start and end).

    ``unpacked`` turns the binary column into an array of integers.
    """
    kept = [c for c in df.columns if c not in (ids, offsets)]
    source = "__text__"
    fields = [df.schema[c] for c in kept] + [T.StructField(ids, T.BinaryType())]
    if offsets:
        fields.append(T.StructField(offsets, OFFSETS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared)
        for batch in batches:
            column = batch.column(len(kept))
            sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
            for part in _slices(sizes, TEXT_AT_ONCE):
                rows = batch.slice(part.start, part.stop - part.start)
                got = own.encode([x or "" for x in rows.column(len(kept)).to_pylist()])
                arrays = [*rows.columns[: len(kept)], pa.array(got, pa.binary())]
                names = [*kept, ids]
                if offsets:
                    spans = [[{"start": int(a), "end": int(b)} for a, b in byte_table(shared).offsets(x)] for x in got]
                    arrays.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
                    names.append(offsets)
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(source)).mapInArrow(lean(run), T.StructType(fields))


def decode(df: DataFrame, shared: Broadcast, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``decoded``, the bytes of the tokens in ``ids`` (binary as ``encode`` makes it); null ids give no bytes."""
    kept = [c for c in df.columns if c != decoded]
    fields = [df.schema[c] for c in kept] + [T.StructField(decoded, T.BinaryType())]
    at = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _CODECS.clear()  # a worker that has encoded before has no more use for it
        own = byte_table(shared)
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_pylist()
            for part in _slices(sizes, 4 * TEXT_AT_ONCE):
                rows = batch.slice(part.start, part.stop - part.start)
                got = [own.decode(x or b"") for x in rows.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(got, pa.binary())], names=[*kept, decoded])

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(lean(run), T.StructType(fields))


def token_count(ids: str = "ids") -> Column:
    return (F.octet_length(F.col(ids)) / 4).cast("long")


def unpacked(df: DataFrame, ids: str = "ids", out: str = "token_ids") -> DataFrame:
    """Adds the ids as an array of integers."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def integers(packed):
        return packed.map(lambda x: np.frombuffer(x or b"", "<i4"))

    return df.withColumn(out, integers(ids))



def as_text(decoded: str = "decoded") -> Column:
    """Decoded bytes as text; bytes that are no whole character give U+FFFD."""
    return F.make_valid_utf8(F.col(decoded).cast("string"))
