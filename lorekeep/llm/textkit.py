"""Vectorised text work inside Arrow batches: slices, words, hashes of byte ranges.

A slice is a run of rows whose texts share one byte buffer. Everything here works on that buffer
with numpy, so the cost per byte does not depend on how the bytes are divided into rows. A text
longer than a slice gets a slice of its own: memory follows the longest text (about 40 bytes per
byte of text), not the size of a batch or a partition.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

ArrowTask = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(task: ArrowTask) -> ArrowTask:
    """``task``, giving back what its worker has freed when it ends.

    Workers outlive their tasks, and what they freed would stay with them, beside the workers of the next stage.
    """

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries have none
            if trim is not None:
                trim(0)

    return run

#: ASCII white space, the only bytes that end a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def folded(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters of UTF-8 bytes in lower case; lengths stay."""
    out = LOWER[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    out[second] += 0x20
    return out


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of a batch with their text bytes and the offsets of each row (nulls are empty)."""
    texts = pc.cast(pc.fill_null(batch.column(column), ""), pa.large_string())
    if not len(texts):
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None and whole.size else np.zeros(0, np.uint8)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start), data[bounds[start] : bounds[end]], bounds[start : end + 1] - bounds[start]
        start = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words: longest runs of bytes that are no separators."""
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    before[:1], after[-1:] = False, False
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (edge[:-1] | ~before))
    ends = np.flatnonzero(inside & (edge[1:] | ~after)) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (splitmix64's last step)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below n; kept between calls."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(n, base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if n <= SLICE_BYTES + 1:
            _powers[base] = known
    return known[:n]


class RangeHash:
    """64-bit hashes of any byte ranges of a buffer, from one running sum."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.inverse = powers(_INVERSE, n + 1)
        self.sums = np.empty(n + 1, np.uint64)
        self.sums[0] = 0
        terms = _BYTE_CODE[data]
        terms *= powers(_BASE, n + 1)[:n]
        np.cumsum(terms, out=self.sums[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Polynomial of the range; ``join`` continues it, ``mix`` makes a hash of it."""
        return (self.sums[ends] - self.sums[starts]) * self.inverse[starts]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.raw(starts, ends) + (np.asarray(ends) - np.asarray(starts)).astype(np.uint64))

    @staticmethod
    def shift(raw: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Polynomial of a range as it counts behind ``lengths`` other bytes."""
        return raw * powers(_BASE, int(lengths.max(initial=0)) + 1)[lengths]


def window_hashes(words: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` successive words of one row, with their rows.

    A row with fewer words, but at least one, has a single window: all its words.
    """
    counts = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    factors = [np.uint64(pow(_BASE, 2 * j + 3, 1 << 64)) for j in range(width)]
    full = np.flatnonzero(np.arange(len(words)) + width <= (first + counts)[rows]) if len(words) else np.zeros(0, np.int64)
    total = np.full(len(full), width, np.uint64)
    for j, factor in enumerate(factors):
        total += words[full + j] * factor
    few = np.flatnonzero((counts > 0) & (counts < width))
    rest = counts[few].astype(np.uint64)
    for j, factor in enumerate(factors[:-1]):
        has = counts[few] > j
        rest[has] += words[first[few[has]] + j] * factor
    return mix(np.concatenate([total, rest])), np.concatenate([rows[full], few])


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` within each row's range."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's ``bigint``."""
    return np.ascontiguousarray(x).view(np.int64)
