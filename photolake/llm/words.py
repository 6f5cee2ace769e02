"""Words, hashes and word shingles of whole Arrow text columns as flat numpy arrays.

A word is a run of ASCII letters, digits or underscores and of any non-ASCII characters, lower-cased. Nothing here
makes a Python object for each word: the bytes of a batch are hashed with a polynomial prefix sum modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser on a uint64 array."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n + 1:
        steps = np.full(n, _P), np.full(n, _P_INVERSE)
        one = np.ones(1, dtype=np.uint64)
        _powers, _inverses = (np.multiply.accumulate(np.concatenate([one, s])) for s in steps)
    return _powers, _inverses


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return data, at - (at[0] if len(at) else 0)


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return raw(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))


def bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of every word; no word spans two rows."""
    is_word = _WORD[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    before = np.empty_like(is_word)
    before[:1], before[1:] = False, is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | edge[:-1]))
    after = np.empty_like(is_word)
    after[-1:], after[:-1] = False, is_word[1:]
    return starts, np.flatnonzero(is_word & (~after | edge[1:])) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range [start, end); ranges are ordered and disjoint. Works in slices of bounded size."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        first = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, first + SLICE, "right")))
        piece = data[first : ends[j - 1]]
        powers, inverses = _tables(max(len(piece), SLICE))
        total = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * powers[: len(piece)], out=total[1:])
        a, b = starts[i:j] - first, ends[i:j] - first
        out[i:j] = mix((total[b] - total[a]) * inverses[a] + (b - a).astype(np.uint64))
        i = j
    return out


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column, and the offsets of its rows in them."""
    data, at = lowered(column)
    starts, ends = bounds(data, at)
    return hashes(data, starts, ends), np.searchsorted(starts, at)


def word_hash(word: str) -> int:
    return int(words(pa.array([word]))[0][0])


def shingles(hashed: np.ndarray, at: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of ``n`` words, and offsets. A row of 1 to n-1 words has one shingle of all its words."""
    counts = np.diff(at)
    short = (counts > 0) & (counts < n)
    sizes = np.where(short, 1, np.maximum(counts - n + 1, 0))
    to = np.concatenate([[0], np.cumsum(sizes)])
    rolled = np.zeros(max(len(hashed) - n + 1, 0), dtype=np.uint64)
    for k in range(n):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + hashed[k : k + len(rolled)]
    out = np.empty(to[-1], dtype=np.uint64)
    full = sizes * ~short
    places = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full - at[:-1], full)
    out[np.repeat(~short, sizes)] = rolled[places]
    for size in range(1, n):
        rows = np.flatnonzero(counts == size)
        value = np.full(len(rows), size, dtype=np.uint64)
        for k in range(size):
            value = value * np.uint64(0xA24BAED4963EE407) + hashed[at[rows] + k]
        out[to[rows]] = value
    return mix(out, 7), to


def pieces(batch: pa.RecordBatch, name: str = "text", size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each (one row at least), so that numpy's copies stay small."""
    column = batch.column(batch.schema.get_field_index(name))
    length = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(length)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + size, "right")))
        yield batch.slice(i, j - i)
        i = j
