"""Words and hashes of Arrow text batches, computed on whole buffers with numpy.

A word is a maximal run of bytes other than the six ASCII white-space bytes, so the same
words come out of UTF-8 bytes as of ``[^\\x20\\x09-\\x0D]+`` on the decoded text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from talkgrain.plans.ship import ship_package

#: Bytes of text handled at once inside a task; a longer document is handled alone.
SLICE_BYTES = 1 << 19

#: Rows of text that Spark hands to a Python task at once, and their bytes.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20

WORD = "[^\\x20\\x09-\\x0D]+"

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df`` as it is; from here on its session hands rows to Python tasks in batches that stay small
    for long texts too, so a task's memory does not depend on how long texts are in a table."""
    ship_package(df.sparkSession)
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        conf.set(f"spark.sql.execution.arrow.{key}", most)
    return df


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def rolling(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any span; one entry more than values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end); equal spans have equal hashes wherever they stand."""
    inverse = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inverse[start])


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; a null is an empty text."""
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes: first row, end row, bytes, offsets from 0."""
    data, offsets = raw(column)
    row, n = 0, len(column)
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of the first word of each row (one entry more)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hash(rolling(byte_values(data)), start, end)


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of every word, from the index of each row's first word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


_PLACES = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``width`` words inside a row; a row with fewer words but at
    least one gives one hash of all its words."""
    n = np.diff(first)
    row = rows_of(first)
    at = np.arange(len(hashes))
    whole = at + width <= first[1:][row]
    at, row = at[whole], row[whole]
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        out += hashes[at + k] * _PLACES[k]
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        extra = np.array([
            sum(int(h) * int(_PLACES[k]) for k, h in enumerate(hashes[first[r]:first[r + 1]])) + int(n[r])
            for r in short
        ], dtype=object)
        out = np.concatenate([out, np.array([int(x) & (1 << 64) - 1 for x in extra], np.uint64)])
        row = np.concatenate([row, short])
    return mix(out), row
