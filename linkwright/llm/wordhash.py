"""Vectorised word and shingle hashes of whole Arrow batches.

A word is a run of bytes outside ``\\x20\\x09-\\x0D``; ASCII letters are lower-cased.  Hashes have 64 bits and are the same in
every process.  Work goes through slices of about ``SLICE`` bytes cut between texts, so that memory stays small; one text longer
than that is one slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_EXACT = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_FOLDED = _EXACT.copy()
_FOLDED[65:91] = _FOLDED[97:123]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE * 2)
        for i, base in enumerate((_ODD, _ODD_INVERSE)):
            p = np.full(size, base)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def _slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, offsets from 0 and bytes of runs of rows."""
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return
    _, places, data = texts.buffers()
    at = np.frombuffer(places, np.int64, n + 1, texts.offset * 8)
    # what stands under a null need not be empty
    if texts.null_count:
        texts = texts.fill_null("")
        _, places, data = texts.buffers()
        at = np.frombuffer(places, np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + SLICE, "right")) - 1)
        yield row, at[row : end + 1] - at[row], data[at[row] : at[end]]
        row = end


def words(texts: pa.Array, fold: bool = True, data: bool = False) -> Iterator[tuple]:
    """For each slice: first row; for each of its rows the number of words; hash, start and end (bytes in the slice) of each word.

    Words that differ in the case of ASCII letters have one hash if fold is set; the slice's bytes follow if data is set.
    """
    table = _FOLDED if fold else _EXACT
    for row, at, raw in _slices(texts):
        inside = ~_SPACE[raw]
        before = np.empty_like(inside)
        before[:1], before[1:] = False, inside[:-1]
        edges = at[:-1][at[:-1] < len(raw)]
        before[edges] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:], after[:-1] = False, inside[1:]
        after[edges[edges > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        power, inverse = _power(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(table[raw] * power[: len(raw)], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        counts = np.diff(np.searchsorted(starts, at))
        yield (row, counts, hashes, starts, ends, *((raw,) if data else ()))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; of all words as one if there are fewer."""
    n = len(hashes)
    if n == 0:
        return hashes
    if n < k:
        out = np.array([n], np.uint64)
        for i in range(n):
            out = mix(out * _ODD + hashes[i : i + 1])
        return out
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * _ODD + hashes[i : n - k + 1 + i])
    return out


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct shingles of its text."""
    for _, counts, hashes, _, _ in words(texts):
        end = 0
        for n in counts.tolist():
            yield np.unique(shingles(hashes[end : end + n], k))
            end += n
