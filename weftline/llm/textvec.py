"""Vectorised text primitives over Arrow string columns.

All functions work on the raw UTF-8 buffer of a batch: no Python object is
made per word or per character. A word is a run of bytes outside
``\\x20\\x09-\\x0D`` - the same split in bytes and in code points, since those
six are ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A fixed random 64-bit value for every byte.
BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class Powers:
    """Powers of the hash base and of its inverse mod 2**64, grown on demand."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            up, down = np.full((2, size), _BASE, dtype=np.uint64)
            down[:] = _INVERSE
            up[0] = down[0] = 1
            cls.up, cls.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return cls.up[:n], cls.down[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with len(data)+1 entries; see ``span_hash``."""
    up, _ = Powers.of(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for whole arrays of spans. It depends
    on the bytes and the length only, not on the position."""
    _, down = Powers.of(len(prefix))
    raw = (prefix[end] - prefix[start]) * down[start]
    return mix64(raw + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets from 0; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, name: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the text of a piece stays near ``limit`` bytes (one
    row at least), which bounds the temporaries whatever a batch holds."""
    _, offsets = buffers(batch.column(name))
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(n, max(start + 1, end))
        yield batch.slice(start, end - start)
        start = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; a word never crosses a row."""
    if not len(data):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    inside = ~SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[heads] = inside[heads]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[tails] = inside[tails]
    s = np.flatnonzero(start)
    e = np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offsets, s, side="right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) of the ``width``-word shingles of every row, A-Z
    lowered, sorted by row then hash. A row with fewer words (one at least)
    has its whole sequence as its one shingle; a row without words has none."""
    lowered = LOWER[data]
    s, e, row = words(lowered, offsets)
    if not len(s):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    one = span_hash(prefix_hash(lowered), s, e)
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    length = np.minimum(count, width)
    index = np.arange(len(s)) - first[row]
    keep = index <= (count - length)[row]
    at = np.flatnonzero(keep)
    rows = row[at]
    value = np.zeros(len(at), dtype=np.uint64)
    for k in range(width):
        used = k < length[rows]
        piece = one[np.minimum(at + k, len(one) - 1)]
        value = np.where(used, mix64(value * np.uint64(0x9FB21C651E98DF25) + piece + np.uint64(k + 1)), value)
    order = np.lexsort((value, rows))
    rows, value = rows[order], value[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (value[1:] != value[:-1])
    return rows[new], value[new]
