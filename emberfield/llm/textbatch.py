"""Arrow batches of texts as flat numpy arrays: words, lines, chunks and shingles.

Everything here works on one slice of rows at a time, so memory follows the
slice (about ``SLICE_BYTES`` of text, or one text if that is longer).
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20

#: What a worker keeps from task to task, such as an encoder with its memory of chunks.
KEPT: dict = {}
#: Gives freed memory between living objects back to the system, where the C library can (glibc).
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None

_BYTES = np.arange(256)
#: Space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)


def give_back() -> None:
    """Give back the memory that Arrow and the C library keep for reuse.

    An idle worker would hold it beside those that serve the next step.
    """
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE_BYTES, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice holds about ``size`` bytes of text, or a single row.

    What other steps have left in ``KEPT`` goes first, unless the caller uses it (``keep``); unused memory
    is given back at the end.
    """
    if KEPT and not keep:
        KEPT.clear()
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(int(np.searchsorted(ends, before + size, side="right")), first + 1)
            yield batch.slice(first, last - first)
            first = last
    batch = None
    give_back()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def encoded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Number equal byte strings alike: an id per string, and the distinct strings."""
    if len(offsets) < 2:
        return np.zeros(0, np.int64), []
    data = np.ascontiguousarray(data)
    strings = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
    )
    coded = strings.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


class Words:
    """Words (runs of bytes that are not white space) of a slice of texts.

    ``ids`` numbers equal words alike, ``distinct`` holds them, and words
    ``bounds[i]:bounds[i + 1]`` belong to row ``i``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        if lower:
            data = LOWER[data]
        self.data, self.offsets = data, offsets
        solid = ~WHITE[data]
        before = np.empty(len(data), bool)
        if len(data):
            before[0], before[1:] = False, solid[:-1]
            before[offsets[:-1][offsets[:-1] < len(data)]] = False
        self.starts = np.flatnonzero(solid & ~before)
        kept = np.concatenate(([0], np.cumsum(solid)))
        self.word_offsets = np.concatenate((kept[self.starts], kept[-1:])) if len(self.starts) else np.zeros(1, np.int64)
        self.bounds = np.searchsorted(self.starts, offsets)
        self.solid = solid
        self.ids, self.distinct = encoded(data[solid], self.word_offsets)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash per word."""
        one = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.distinct), np.uint64, len(self.distinct))
        return one[self.ids] if len(one) else np.zeros(0, np.uint64)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def mixed(parts: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash of several aligned hash arrays, order-sensitive."""
    out = np.full(len(parts[0]), 0x9E3779B97F4A7C15, np.uint64)
    for part in parts:
        out = (out ^ part) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
    return out


def windows(values: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First positions of all windows of ``width`` inside rows, and their bounds per row."""
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    ends = np.concatenate(([0], np.cumsum(counts)))
    first = np.arange(ends[-1]) + np.repeat(bounds[:-1] - ends[:-1], counts)
    return first, ends


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes per row, and their bounds.

    A row with fewer words than ``width`` has its whole sequence as the only
    shingle; a row without words has none.
    """
    h, bounds = words.hashes(), words.bounds
    n = np.diff(bounds)
    first, ends = windows(h, bounds, width)
    values = mixed([h[first + k] for k in range(width)]) if len(first) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        whole = np.array(
            [xxhash.xxh3_64_intdigest(h[bounds[i] : bounds[i + 1]].tobytes(), 7) for i in short], np.uint64
        )
        values = np.insert(values, ends[short], whole)
        ends = ends + np.concatenate(([0], np.cumsum((n > 0) & (n < width))))
    for a, b in zip(ends[:-1], ends[1:]):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[ends[:-1][ends[:-1] < len(values)]] = True
    kept = np.concatenate(([0], np.cumsum(new)))
    return values[new], kept[ends]
