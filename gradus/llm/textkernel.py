"""Vectorised word kernel: words, word hashes and shingles of a batch of texts.

Works on the raw UTF-8 buffer of an Arrow column with numpy only; no Python string is
made per word. Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` and A-Z
counts as a-z, as the contracts of the corpus operators ask. A word hash is a sum of
mixed (byte, position) values, a shingle hash a mixed sum over five word hashes, both
of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one pass of the kernel holds in its arrays (a longer text is a pass of its own).
CHUNK_BYTES = 1 << 19
SHINGLE = 5

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each text's first word (one more at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    black = ~_WHITE[data]
    first = black.copy()
    first[1:] &= ~black[:-1]
    last = black.copy()
    last[:-1] &= ~black[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] = black[cuts]
    last[cuts - 1] = black[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.uint64)
    x = _BYTE.take(data[place.view(np.int64) + np.repeat(starts - firsts, lengths)])
    place -= np.repeat(firsts.astype(np.uint64), lengths)
    place *= _STEP
    x += place
    x ^= x >> np.uint64(32)
    x *= _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    sums = np.add.reduceat(x, firsts)
    return mix(sums + lengths.astype(np.uint64) * _STEP)


def shingles(hashes: np.ndarray, firsts: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles.

    A text of fewer words than ``size`` has its whole sequence as one; one without words has none.
    """
    out = []
    n = len(hashes)
    if n >= size:
        rolled = np.zeros(n - size + 1, np.uint64)
        for j in range(size):
            rolled += (hashes[j : n - size + 1 + j] ^ (hashes[j : n - size + 1 + j] >> np.uint64(29))) * _ODD[j]
        rolled = mix(rolled)
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.sort(rolled[a : b - size + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            h = hashes[a:b]
            out.append(mix(((h ^ (h >> np.uint64(29))) * _ODD[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.full(1, b - a, np.uint64) * _STEP))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def text_shingles(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets) by runs of rows."""
    for row, _, data, offsets in chunks(column):
        starts, ends, firsts = words(data, offsets)
        yield row, shingles(word_hashes(data, starts, ends), firsts)
