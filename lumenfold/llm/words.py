"""Whole-column word kernels on Arrow buffers.

A word is a maximal run of bytes other than space and \\x09-\\x0D, with A-Z lowered; that is the
contract's ``[^\\x20\\x09-\\x0D]+``. Kernels work on the column's byte buffer, so no Python string is
made per word, and in pieces of ``PIECE`` bytes, so memory does not follow the batch.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import hashlib

import numpy as np
import pyarrow as pa

PIECE = 3 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASIS, _PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)
_LONG = 64


def tidy(kernel):
    """Wraps a kernel of Arrow batches: what it has freed goes back to the system when its task ends.

    Python workers are reused by later stages, and allocators keep freed memory otherwise.
    """

    @functools.wraps(kernel)
    def run(batches, *args, **kwargs):
        try:
            yield from kernel(batches, *args, **kwargs)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; ``salt`` picks one of a family."""
    with np.errstate(over="ignore"):
        h = h + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls read as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = PIECE):
    """Row ranges (a, b) of at most ``most`` bytes each, or one longer row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the words, and per row the index of its first word (rows + 1 entries)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(raw)]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = edge[edge > 0] - 1
    last[edge] = inside[edge]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts, np.searchsorted(starts, offsets)


def hash_words(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of the lower-cased words (``raw`` as given; lowering happens here)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    order = np.argsort(-np.minimum(lengths, _LONG + 1).astype(np.int16), kind="stable")
    s, n = starts[order], np.minimum(lengths[order], _LONG + 1)
    h = np.full(len(s), _BASIS)
    counts = np.searchsorted(-n, -np.arange(_LONG + 1), "left")  # words longer than j
    low = _LOWER[raw]
    with np.errstate(over="ignore"):
        for j in range(_LONG):
            k = counts[j]
            if not k:
                break
            h[:k] = (h[:k] ^ low[s[:k] + j]) * _PRIME
    out = np.empty(len(s), np.uint64)
    out[order] = mix(h ^ n.astype(np.uint64))
    for i in np.flatnonzero(lengths > _LONG):
        out[i] = int.from_bytes(hashlib.blake2b(low[starts[i] : starts[i] + lengths[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``k`` words inside a row, and the row bounds in them.

    A row of fewer than ``k`` words, but at least one, has its whole sequence as its one shingle.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    at = np.arange(bounds[-1]) - bounds[row] + first[:-1][row]
    used = np.minimum(n, k)[row]
    with np.errstate(over="ignore"):
        h = mix(used.astype(np.uint64), 7)
        for j in range(k):
            live = used > j
            if live.all():
                h = mix(h ^ words[at + j], j + 1)
            else:
                h[live] = mix(h[live] ^ words[at[live] + j], j + 1)
    return h, bounds
