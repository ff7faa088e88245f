"""Vectorised helpers over the bytes of a column of texts.

An Arrow string column is one byte buffer with offsets. Words and n-grams are found and
hashed with whole-array NumPy operations, so that no Python object is made per word. The
hash of a byte string is a polynomial with random 64-bit byte values modulo 2**64, taken
from prefix sums: (P[end] - P[start]) * base**-start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that separate words: white space (\x20 and \x09-\x0D).
SPACES = np.zeros(256, dtype=bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True

_powers = np.zeros(0, dtype=np.uint64)
_inverses = np.zeros(0, dtype=np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n + 1:
        size = max(n + 1, 1 << 16)
        with np.errstate(over="ignore"):
            _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, _BASE, dtype=np.uint64))])
            _inverses = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, _INVERSE, dtype=np.uint64))])
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every input bit over all output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        width = np.int32
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    if len(offsets) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, max_bytes: int = 1 << 20, max_rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts take about ``max_bytes``; a longer text has a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + max_bytes, side="right")) - 1
        last = min(max(last, first + 1), first + max_rows, n)
        yield first, last
        first = last


def polynomials(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums P of the bytes' polynomial, and the inverse powers: (P[end] - P[start]) * inverse[start] is a run's hash."""
    powers, inverses = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_VALUES[data] * powers[: len(data)], out=sums[1:])
    return sums, inverses


class Words:
    """The words of some texts: hash, first and last byte of each, and the words' range per text.

    With ``tails``, a full stop or comma between a letter a-z and a gap is a word of its own; with
    ``singles``, so is every character of three or four bytes (scripts without spaces are among them).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES, lower: bool = True, tails: bool = False, singles: bool = False):
        data = LOWER[data] if lower else data
        n = len(data)
        self.data = data
        gap = np.ones(n + 2, dtype=bool)
        gap[1:-1] = separators[data]
        inside = ~gap[1:-1]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        if tails and n > 1:
            mark = ((data[1:] == 46) | (data[1:] == 44)) & (data[:-1] >= 97) & (data[:-1] <= 122) & (gap[3:] | edge[2:])
            edge[1:-1] |= mark & ~edge[1:-1]
        if singles:
            firsts = np.flatnonzero((data & 0xC0) != 0x80)
            wide = np.flatnonzero(data[firsts] >= 0xE0)
            edge[firsts[wide]] = True
            edge[np.append(firsts, n)[wide + 1]] = True
        self.start = np.flatnonzero(inside & (gap[:-2] | edge[:-1]))
        self.end = np.flatnonzero(inside & (gap[2:] | edge[1:])) + 1
        sums, inverses = polynomials(data)
        with np.errstate(over="ignore"):
            self.hash = mix((sums[self.end] - sums[self.start]) * inverses[self.start])
        self.bounds = np.searchsorted(self.start, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


_PLACES = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive words, by the place of its first word."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = word_hash[:n] * _PLACES[0]
        for i in range(1, k):
            total += word_hash[i : i + n] * _PLACES[i]
    return mix(total)


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text, sorted, how often each occurs, and the bounds of each text's set.

    A text of fewer than k words, but not none, has its whole sequence as its one shingle.
    """
    n_texts = len(words.bounds) - 1
    counts = words.counts()
    runs = shingle_hashes(words.hash, k)
    text_of = np.repeat(np.arange(n_texts), np.maximum(counts - k + 1, 0))
    first = words.bounds[:-1]
    own = np.maximum(counts - k + 1, 0)
    place = np.arange(len(text_of)) - np.repeat(np.cumsum(own) - own, own)
    hashes = runs[np.repeat(first, own) + place] if len(text_of) else np.zeros(0, dtype=np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        with np.errstate(over="ignore"):
            whole = np.full(len(short), 0x51ED270B, dtype=np.uint64)
            for i in range(k - 1):
                has = counts[short] > i
                whole[has] = mix(whole[has] * _PLACES[32 + i] + words.hash[first[short[has]] + i])
        text_of = np.concatenate([text_of, short])
        hashes = np.concatenate([hashes, whole])
    order = np.lexsort((hashes, text_of))
    text_of, hashes = text_of[order], hashes[order]
    times = np.zeros(0, dtype=np.int64)
    if len(hashes):
        fresh = np.ones(len(hashes), dtype=bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (text_of[1:] != text_of[:-1])
        times = np.diff(np.append(np.flatnonzero(fresh), len(hashes)))
        text_of, hashes = text_of[fresh], hashes[fresh]
    return hashes, times, np.searchsorted(text_of, np.arange(n_texts + 1))
