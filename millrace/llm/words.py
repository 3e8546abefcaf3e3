"""Words and word shingles of whole Arrow batches, as arrays or 64-bit hashes, without a Python string for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Lower-cases A-Z only; any other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}
#: Powers that a worker keeps; only longer texts need more.
KEPT = (1 << 20) + (1 << 17)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64; as many as a step of text needs are kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, KEPT), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have[:KEPT].copy() if n > KEPT else have
    return have[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """n+1 sums of code times power: the hash of any range of bytes is one difference times a power."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the byte ranges [start, end); equal ranges give equal numbers, wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(_INVERSE, len(prefix))[start] + (end - start).astype(np.uint64))


def cut_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of texts without nulls as one array of bytes, A-Z in lower case, and the number of words of each text; bytes that are no UTF-8 stay."""
    large = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(text.view(pa.large_string() if large else pa.string())))
    lists = pc.ascii_split_whitespace(trimmed)
    flat, sizes = lists.flatten().view(pa.large_binary() if large else pa.binary()), np.diff(lists.offsets.to_numpy()).astype(np.int64)
    blank = pc.binary_length(trimmed).to_numpy() == 0
    if blank.any():  # a text without a word is cut into an empty one
        sizes[blank] = 0
        flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
    return flat, sizes


def word_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word: a run of bytes other than white space within one row."""
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], word[:-1]))
    after = np.concatenate((word[1:], [False]))
    start = np.flatnonzero(word & (~before | edge[:-1]))
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each row the sorted distinct 63-bit hashes of its word shingles.

    Fewer words than ``width`` make one shingle; no word makes none.
    """
    low = LOWER[data]
    start, end, row = word_ranges(low, offsets)
    hashes = range_hashes(prefix_hashes(low), start, end)
    at = np.searchsorted(row, np.arange(len(offsets)))
    rolled = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        rolled = mix(rolled + hashes[k : k + len(rolled)] * np.uint64(2 * k + 3))
    out = []
    for i in range(len(offsets) - 1):
        n = at[i + 1] - at[i]
        if n >= width:
            own = rolled[at[i] : at[i + 1] - width + 1]
        else:
            own = np.zeros(min(n, 1), np.uint64)
            for k in range(n):
                own = mix(own + hashes[at[i] + k : at[i] + k + 1] * np.uint64(2 * k + 3) + np.uint64(n))
        out.append(np.unique(own >> np.uint64(1)).astype(np.int64))
    return out
