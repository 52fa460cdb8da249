"""Array helpers for Arrow text columns: slices, words, and polynomial fingerprints.

All fingerprints are 64-bit values computed with wrap-around arithmetic over whole numpy
arrays; a Python loop never runs over characters or words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

U = np.uint64
BASE = 0x9E3779B97F4A7C16 | 1                     # odd; BASE - 1 has a single factor of 2
INVERSE = pow(BASE, -1, 1 << 64)
SLICE = 1 << 18                                   # bytes of text handled by one array step


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (bijective), so that every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i in 0..n."""
    up, down = np.full(n + 1, U(BASE)), np.full(n + 1, U(INVERSE))
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Rolling:
    """Fingerprints of any span of a unit sequence in O(1) each, from one running sum."""

    def __init__(self):
        self.up, self.down = powers(SLICE + 64)

    def sums(self, units: np.ndarray) -> np.ndarray:
        n = len(units)
        if n >= len(self.up):
            self.up, self.down = powers(2 * n)
        out = np.zeros(n + 1, U)
        np.cumsum(units * self.up[:n], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start, end) -> np.ndarray:
        """The mixed fingerprint of units[start:end] for arrays of starts and ends."""
        return mix((sums[end] - sums[start]) * self.down[start])

    def windows(self, sums: np.ndarray, length: int) -> np.ndarray:
        """The mixed fingerprint of every window of ``length`` units."""
        n = max(0, len(sums) - length)
        return mix((sums[length:] - sums[:n]) * self.down[:n])


BYTE_UNITS = mix(np.arange(1, 257, dtype=U))
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def binary(column: pa.Array) -> pa.Array:
    """A text or binary column as large_binary; NULL becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).fill_null(b"")


def slices(column: pa.Array, limit: int = SLICE):
    """(first row, last row + 1, bytes, offsets) of runs of rows of about ``limit`` bytes;
    a longer row comes alone and whole."""
    column = binary(column)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(n, j)
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray):
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the row of each word."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~SPACES[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:n]
    ends = inside
    ends[:-1] = inside[:-1] & (~inside[1:] | cut[1:n])
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(offsets, s, "right") - 1


def run_starts(row: np.ndarray, rows: int) -> np.ndarray:
    """First index of each row's items in a sorted ``row`` array, with the end appended."""
    return np.searchsorted(row, np.arange(rows + 1))


def sliding(values: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """best() over every window of ``width`` values, by doubling."""
    out, k = values, 1
    if len(values) < width:
        return values[:0]
    while 2 * k <= width:
        out = best(out[:-k], out[k:])
        k *= 2
    if k < width:
        out = best(out[:len(values) - width + 1], out[width - k:width - k + len(values) - width + 1])
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated aranges: starts[i], starts[i]+1, ... (lengths[i] of them)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total, dtype=np.int64) + shift


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A flag for each of n positions: does any span [start, end) hold it?"""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, ends, -1)
    return np.cumsum(delta[:-1]) > 0


def with_results(docs: DataFrame, text_col: str, run, schema: StructType) -> DataFrame:
    """Columns ``doc`` (a struct of the input's columns) and those of ``schema``, which
    ``run`` makes of the texts: a function from an iterator of text arrays to one of struct
    arrays. Only texts go to Python, and only results come back."""
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run(texts)
        release()

    # not deterministic for the optimizer: a filter on a result must not evaluate it again
    made = F.arrow_udf(scored, schema).asNondeterministic()
    names = docs.columns
    doc = F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc")
    out = docs.select(doc, F.col(f"`{text_col}`").cast("string").alias("t")).select("doc", made("t").alias("made"))
    return out.select("doc", *[F.col(f"made.{f.name}") for f in schema.fields])


def release() -> None:
    """Gives freed memory back at the end of a task: a worker that Spark uses again should
    not hold the most that any earlier task needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass                                      # another C library
