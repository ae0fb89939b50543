"""Vectorised words and shingles of Arrow string batches, for use inside tasks.

Words are maximal runs of bytes other than ASCII white space
(``[^\\x20\\x09-\\x0D]+``); in UTF-8 no byte of a longer character is one of
these, so bytes and characters agree.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.Generator(np.random.PCG64(20240607))
_SPAN = 64
#: Bytes of words that are hashed at a time.
_STRETCH = 4 << 20
_TABLE = _RNG.integers(0, 2**64, size=_SPAN * 256, dtype=np.uint64)
#: Odd multipliers by place in a shingle; they tell apart the orders of words.
_PLACES = _RNG.integers(0, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    bufs = column.buffers()
    at = np.frombuffer(bufs[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8)[at[0] : at[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def release() -> None:
    """Give memory that a task no longer needs back to the machine: workers live on, and the next task may be another operator's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of ``column``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(sizes) - sizes) // most
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
    release()


class Words:
    """Words of a batch: ``start``/``end`` in ``data``, ``hash`` and ``doc`` per word, ``first`` (n + 1) per document."""

    def __init__(self, column: pa.Array, lower: bool = False):
        data, at = strings(column)
        if lower:
            data = _LOWER[data]
        self.data, self.at, n = data, at, len(at) - 1
        live = ~_SPACE[data]
        begins, ends = live.copy(), live.copy()
        begins[1:] &= ~live[:-1]
        ends[:-1] &= ~live[1:]
        edge = at[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        begins[edge] = live[edge]
        ends[edge - 1] = live[edge - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, at)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))
        self.live = live
        self._hash = None

    @property
    def hash(self) -> np.ndarray:
        """64-bit hashes by random tables for place and byte; words of over 64 bytes by BLAKE2b."""
        if self._hash is None:
            size = self.end - self.start
            if not len(size):
                self._hash = np.zeros(0, np.uint64)
                return self._hash
            out, begin, total = np.empty(len(size), np.uint64), np.cumsum(size) - size, int(size.sum())
            # long texts are hashed a stretch of words at a time, as the tables are eight times their bytes
            cuts = np.unique(np.searchsorted(begin, np.arange(0, total, _STRETCH), "right") - 1)
            for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(size)], strict=True):
                a, b = self.start[i], self.end[j - 1]
                chars = self.data[a:b][self.live[a:b]]
                own = begin[i:j] - begin[i]
                place = np.arange(len(chars)) - np.repeat(own, size[i:j])
                out[i:j] = np.bitwise_xor.reduceat(_TABLE[((place & (_SPAN - 1)) << 8) | chars], own)
            for i in np.flatnonzero(size > _SPAN):
                out[i] = int.from_bytes(blake2b(self.data[self.start[i] : self.end[i]].tobytes(), digest_size=8).digest(), "little")
            self._hash = out
        return self._hash

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of each run of ``k`` words inside one document."""
        h = self.hash
        if len(h) < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        m = len(h) - k + 1
        out = np.zeros(m, np.uint64)
        for j in range(k):
            out += h[j : j + m] * _PLACES[j]
        inside = self.doc[:m] == self.doc[k - 1 :]
        return out[inside], np.flatnonzero(inside)

    def shingles(self, k: int) -> Iterator[np.ndarray]:
        """For each document its sorted distinct ``k``-word shingles; with fewer words, the whole sequence as one."""
        h, where = self.windows(k)
        cut = np.searchsorted(where, self.first)
        words = self.hash
        for i in range(len(self.at) - 1):
            n = self.first[i + 1] - self.first[i]
            if n >= k:
                yield np.unique(h[cut[i] : cut[i + 1]])
            elif n:
                part = words[self.first[i] : self.first[i + 1]] * _PLACES[:n]
                yield np.array([part.sum(dtype=np.uint64) ^ np.uint64(n)], np.uint64)
            else:
                yield np.zeros(0, np.uint64)
