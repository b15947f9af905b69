"""Helpers that several text operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeframe.llm.textvec import mix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names.

    Only a local master may lack that setting; it then gets a temporary folder. On a cluster a folder of the
    driver's own disk would be invisible to executors, so the setting is demanded there.
    """
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="strikeframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch, where the session doesn't say otherwise: texts are long, and a worker holds a batch several times.
BATCH_BYTES = "8m"


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, unless the session has a bound of its own below Spark's."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "64m"):
        spark.conf.set(name, BATCH_BYTES)


def trim() -> None:
    """Gives memory that a Python worker no longer uses back to the machine: workers idle for a while before they end."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc keeps its own counsel
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` whose worker is trimmed when its partition is done."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return trimmed


def lean_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function for ``applyInArrow`` whose worker is trimmed after a group."""

    def trimmed(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            trim()

    return trimmed


def written(df: DataFrame, label: str, scratch: list[str] | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives the loss of executors.

    The shuffle files of the query that made it go when it is written. The table's path is added to ``scratch``, if
    given, for ``discard``.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = shared_folder(spark, label)
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that no frame in use is read from."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    paths.clear()


def utf8(column: str) -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def crc_fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


#: Bits of a membership filter for each key, at least and at most: 32 MB at most, however many keys it holds.
BITS_A_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 18, 1 << 28
#: Parts that a filter is made in.
SLICES = 64


def filter_places(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys.view(np.uint64).copy()) % np.uint64(bits)).astype(np.int64)


def membership(keys: DataFrame) -> Broadcast:
    """Bits for a column of 64-bit keys, for sparing rows that surely have none of them a shuffle. No key is missed.

    Keys are dealt by their place among the bits, so that each task marks parts of its own.
    """
    small_batches(keys.sparkSession)
    n = keys.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_KEY * n).bit_length()))
    width = bits // SLICES

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = filter_places(np.asarray(batch.column(0)), bits)
            yield pa.RecordBatch.from_arrays([pa.array((at // width).astype(np.int32)), pa.array((at % width).astype(np.int32))], names=["slice", "at"])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields: dict[int, np.ndarray] = {}
        for batch in batches:
            slices, at = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for k in np.unique(slices):
                fields.setdefault(int(k), np.zeros(width, bool))[at[slices == k]] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array([*fields], pa.int32()), pa.array([np.packbits(f).tobytes() for f in fields.values()], pa.binary())], names=["slice", "field"]
        )

    parts = keys.mapInArrow(placed, "slice int, at int").repartition(SLICES, "slice").mapInArrow(marked, "slice int, field binary")
    field = bytearray(bits // 8)
    for r in parts.collect():  # no more than MOST_BITS in all
        field[r.slice * width // 8 : (r.slice + 1) * width // 8] = r.field
    return keys.sparkSession.sparkContext.broadcast(bytes(field))


def has(shared: Broadcast, keys: np.ndarray) -> np.ndarray:
    """Which keys may be among those of ``membership``."""
    field = np.frombuffer(shared.value, np.uint8)
    at = filter_places(keys, 8 * len(field))
    return (field[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
