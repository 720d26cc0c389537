"""Words of UTF-8 texts as numpy arrays: spans, hashes and hashes of runs of words.

All functions work on a batch of texts that lie one after another in one byte buffer, as
Arrow keeps them. Every byte of a non-ASCII character counts as a word byte, so words can
be cut on bytes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_KEYS = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: ASCII letters and digits, and everything beyond ASCII.
ALNUM = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
#: Everything but the ASCII white space.
NOT_SPACE = np.array([c != 32 and not 9 <= c <= 13 for c in range(256)])
#: A-Z to a-z.
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null is empty."""
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = filled.buffers()
    bounds = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    if data is None or not len(filled):
        return np.zeros(0, np.uint8), np.zeros(len(filled) + 1, np.int64)
    whole = np.frombuffer(data, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


class Words(NamedTuple):
    """Words of a batch, in order. ``row``: number of the text; ``start``, ``end``: bytes."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # per text, its first word; one more entry than texts


def split_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool = True) -> Words:
    """The maximal runs of word bytes of each text."""
    inside = is_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first_bytes = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first_bytes] = inside[first_bytes]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:]
    finishes[first_bytes[1:] - 1] = inside[first_bytes[1:] - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(row, start, end, _hashes(data, start, end, lower), first)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash per span, from sums over the bytes; a few spans at a time."""
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    cuts = [0]
    while cuts[-1] < len(start):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(end, start[cuts[-1]] + _PIECE, "right"))))
    for a, b in zip(cuts, cuts[1:], strict=False):
        low = start[a]
        piece = data[low : end[b - 1]]
        sums, inverse = prefix_hashes(LOWER[piece] if lower else piece)
        out[a:b] = hash_spans(sums, inverse, start[a:b] - low, end[a:b] - low)
    return out


def prefix_hashes(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``hash_spans`` needs to hash any span of the bytes."""
    n = len(piece) + 1
    power = np.full(n, _BASE)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    inverse = np.full(n, _BASE_INVERSE)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    sums = np.zeros(n, np.uint64)
    np.cumsum(_BYTE_KEYS[piece] * power[:-1], out=sums[1:])
    return sums, inverse


def hash_spans(sums: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values; a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(hashes: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of each run of ``k`` consecutive values, also of runs across texts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor = np.uint64(0xD6E8FEB86659FD93 + 2 * seed)
    out = np.full(n, np.uint64(k * 1_000_003 + seed))
    for j in range(k):
        out = out * factor + hashes[j : j + n]
    return mix(out)


def runs_inside(words: Words, k: int) -> np.ndarray:
    """Starts of the runs of ``k`` words that lie in one text."""
    n = len(words.row) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(words.row[:n] == words.row[k - 1 :])


def text_slices(column: pa.Array, most_bytes: int = 4 << 20):
    """Row ranges of a column of which each has few bytes, or is one row."""
    _, offsets = utf8(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most_bytes, "right")) - 1)
        yield a, min(b, len(column))
        a = b
