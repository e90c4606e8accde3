"""Hashes of word shingles for many texts at once, in numpy.

A word's hash is a polynomial of its bytes, taken from prefix sums over the whole buffer (arithmetic modulo 2^64, with
the inverse of the base to shift words to one place), then scrambled. A shingle's hash is a scrambled polynomial of
its words' hashes. A text with fewer words than a shingle has one shingle of all its words; an empty one has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from shelfmark.llm.common import batch_bytes, mix64

WORDS = 5
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... (at least n of them), kept for the next call."""
    kept = _powers.get(base)
    if kept is None or len(kept) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        kept = _powers[base] = np.multiply.accumulate(out)
    return kept


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts, and each text's number of words."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    solid = ~_BLANK[data]
    begins = np.empty(n + 1, bool)
    begins[0], begins[n] = True, True
    begins[1:n] = ~solid[:-1]
    begins[offsets] = True  # a text's first character begins a word, and its last one ends one
    starts = np.flatnonzero(solid & begins[:n])
    follows = np.empty(n, bool)
    follows[:-1] = ~solid[1:]
    follows[n - 1] = True
    inner = offsets[1:-1]
    follows[inner[inner > 0] - 1] = True
    ends = np.flatnonzero(solid & follows) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n)[:n], out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * _power(_INVERSE, n)[starts])
    return hashes, np.diff(np.searchsorted(starts, offsets))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, and each text's number of them; repeats are kept."""
    words, counts = word_hashes(*batch_bytes(texts))
    total = len(words)
    width = np.minimum(counts, WORDS)
    number = np.where(counts > 0, counts - width + 1, 0)
    if total == 0:
        return words, number
    base = np.uint64(_INVERSE)
    whole = np.zeros(total, np.uint64)
    m = max(total - WORDS + 1, 0)
    for k in range(WORDS):
        whole[:m] = (whole[:m] + words[k : k + m]) * base
    first, begin = np.cumsum(counts) - counts, np.cumsum(number) - number
    out = whole[np.arange(number.sum()) + np.repeat(first - begin, number)]
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    value = counts[short].astype(np.uint64)
    for k in range(WORDS - 1):
        more = counts[short] > k
        value[more] = (value[more] + words[first[short[more]] + k]) * base
    out[begin[short]] = value
    return mix64(out), number
