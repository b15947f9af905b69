"""Words and their hashes for a whole Arrow batch at once, over the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes and rows of text that are worked on at a time; a longer text is taken alone, whole.
BYTES_AT_ONCE, ROWS_AT_ONCE = 1_000_000, 2048

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D  # odd, so it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)

#: A second set of codes, and another base for it; both hashes together have 128 bits.
MORE_CODES = mix(BYTE_CODES + _GOLDEN)
MORE_BASE = 0x9E6C63D0676A9A99

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        made = []
        for factor in (base, pow(base, -1, 1 << 64)):
            steps = np.full(max(n, BYTES_AT_ONCE), factor, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS[base] = (made[0], made[1])
    up, down = _POWERS[base]
    return up[:n], down[:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column in one array, and where each row begins (one more entry ends the last)."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(bounds):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def portions(bounds: np.ndarray, most: int = BYTES_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes and at most ROWS_AT_ONCE rows; each row is whole."""
    n, i = len(bounds) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        j = min(j, i + ROWS_AT_ONCE, n)
        yield i, j
        i = j


def words(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes that are no separators; rows don't run together."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~separator[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[bounds] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | fresh[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = BYTE_CODES, base: int = _BASE) -> np.ndarray:
    """A 64-bit hash of each run, from sums of byte codes times powers of a base."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1, base)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def row_counts(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n)


def distinct_in_rows(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row, sorted by row and value."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[keep], rows[keep]


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct ``width``-word shingles of each row, with the rows; both sorted by row, then hash.

    A-Z are lower-cased; words are separated by white space of ASCII. A row of fewer words, but not none, has its
    whole sequence as its one shingle.
    """
    data = LOWER[data]
    starts, ends, rows = words(data, bounds, WHITE)
    n = len(bounds) - 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes = word_hashes(data, starts, ends)
    factors = mix((np.arange(1, width + 1, dtype=np.uint64)) * _GOLDEN) | np.uint64(1)
    count = row_counts(rows, n)
    hashes = [np.zeros(0, np.uint64)]
    at = [np.zeros(0, np.int64)]
    if len(codes) >= width:
        whole = np.flatnonzero(rows[: len(rows) - width + 1] == rows[width - 1 :])
        total = np.zeros(len(whole), np.uint64)
        for j in range(width):
            total += codes[whole + j] * factors[j]
        hashes.append(mix(total))
        at.append(rows[whole])
    first = np.cumsum(count) - count
    for few in range(1, width):
        short = np.flatnonzero(count == few)
        total = np.full(len(short), few, np.uint64) * _GOLDEN
        for j in range(few):
            total += codes[first[short] + j] * factors[j]
        hashes.append(mix(total ^ np.uint64(0x5851F42D4C957F2D)))
        at.append(short)
    return distinct_in_rows(np.concatenate(hashes), np.concatenate(at))
