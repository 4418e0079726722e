"""Zero-copy access to the UTF-8 bytes of Arrow string columns, in bounded slices.

Spark hands ``mapInArrow`` batches of up to 10,000 rows; a batch of long texts
can hold tens of MB and numpy temporaries are eight times as wide, so every
operator works on slices of at most ``SLICE`` bytes (one text may exceed that).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE = 1 << 19


def release() -> None:
    """Give the memory that a task has freed back to the system; Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null text is empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) that hold at most ``most`` bytes, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` in slices: ``fn`` gets batches with a bounded number of text bytes in column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
            for i, j in slices(offsets):
                yield fn(batch.slice(i, j - i))

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit hashes (shift, xor, multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys64(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers; the i-th doesn't depend on n."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space), and the first word of each text (one more at the end)."""
    inside = ~SEPARATOR[raw]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    at = offsets[:-1][offsets[:-1] < len(raw)]
    before[at] = False
    at = offsets[1:-1]
    after[at[at > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 7) -> np.ndarray:
    """64-bit hashes of the words, A-Z lower-cased."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    first = np.zeros(len(size), np.int64)
    np.cumsum(size[:-1], out=first[1:])
    place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    at = place + np.repeat(starts, size)
    value = (LOWER[raw[at]].astype(np.uint64) + np.uint64(1)) * keys64(int(size.max()), seed)[place]
    return mix64(np.add.reduceat(value, first) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def fold(raw: np.ndarray, offsets: np.ndarray, digits: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes and offsets: Latin letters lower-cased, ASCII signs (and digits, if not ``digits``) one space, each text ended by one space.

    Letters beyond U+00FF keep their case; bytes over 0x7F count as letters.
    """
    table = _KEEP_DIGITS if digits else _LETTERS_ONLY
    n = len(offsets) - 1
    wide = np.insert(raw, offsets[1:], 32) if n else raw  # a space ends each text
    off = offsets + np.arange(n + 1)
    out = table[wide]
    high = np.flatnonzero(wide == 0xC3)
    high = high[high + 1 < len(wide)]
    after = wide[high + 1]
    up = (after >= 0x80) & (after <= 0x9E) & (after != 0x97)
    out[high[up] + 1] += 32
    space = out == 32
    keep = np.ones(len(out), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    if len(out):
        keep[0] = True
    first = off[:-1][off[:-1] < len(out)]
    keep[first] &= ~(space[first])  # no space starts a text ...
    for_all = off[1:] - 1
    keep[for_all] = True  # ... but one ends it, even an empty one
    total = np.concatenate(([0], np.cumsum(keep)))
    out, off = out[keep], total[off]
    # a text that ended in signs now has two spaces at its end: drop the first
    ends = off[1:] - 1
    twice = ends[(ends - 1 >= off[:-1])]
    twice = twice[out[twice - 1] == 32] - 1
    if len(twice):
        drop = np.ones(len(out), bool)
        drop[twice] = False
        total = np.concatenate(([0], np.cumsum(drop)))
        out, off = out[drop], total[off]
    return out, off


_KEEP_DIGITS = np.full(256, 32, np.uint8)
_KEEP_DIGITS[128:] = np.arange(128, 256)
_KEEP_DIGITS[97:123] = np.arange(97, 123)
_KEEP_DIGITS[65:91] = np.arange(97, 123)
_LETTERS_ONLY = _KEEP_DIGITS.copy()
_KEEP_DIGITS[48:58] = np.arange(48, 58)
