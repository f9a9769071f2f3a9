"""Shared vectorised text helpers: batch slicing, word hashing, row counts.

Word hashes work on the UTF-8 bytes that Arrow already holds, without making Python strings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

U64 = np.uint64
#: Odd multipliers of the polynomial hashes over bytes and over words.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about max_bytes of text each; one longer text is a part of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(ends):
        floor = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, floor + max_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text") -> DataFrame:
    """mapInArrow over parts of bounded text size; fn maps one part to one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield fn(part)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over an array of uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, base, U64)]), dtype=U64)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n."""
    size = 1 << max(16, (max(n, 1) - 1).bit_length())
    return _powers(base, size)[:n], _powers(pow(base, -1, 1 << 64), size)[:n]


def sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(values, out=out[1:], dtype=U64)
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty), and the n + 1 offsets of its rows in them."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n, (_, offsets, data) = len(column), column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a string column, words by row (n + 1 offsets), and the hash of the empty row set.

    A word is a maximal run of bytes that are not ASCII white space; words never span rows.
    Returns (hash per word, offsets of rows in words, first byte of each word).
    """
    data, at = utf8(column)
    n = len(data)
    solid = ~WHITE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:n]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | edge[1:n]
    first, last = np.flatnonzero(start), np.flatnonzero(stop) + 1
    up, down = powers(BYTE_BASE, n)
    with np.errstate(over="ignore"):
        total = sums((data.astype(U64) + U64(1)) * up)
        hashed = mix((total[last] - total[first]) * down[first]) if len(first) else np.zeros(0, U64)
    return hashed, np.searchsorted(first, at), first


def windows(hashed: np.ndarray, size: int, base: int = WORD_BASE) -> np.ndarray:
    """The hash of each run of size consecutive words, by its first word; len(hashed) - size + 1 values, row ends ignored."""
    n = len(hashed)
    if n < size:
        return np.zeros(0, U64)
    up, down = powers(base, n)
    with np.errstate(over="ignore"):
        total = sums(hashed * up)
        return mix((total[size:] - total[: n - size + 1]) * down[: n - size + 1] + U64(size))
