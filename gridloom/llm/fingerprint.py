"""Document fingerprints: one-permutation MinHash.

Each five-word shingle is hashed once; its top bits choose a bin, and a bin keeps its
least value. Empty bins take the value of another bin by optimal densification: bin i asks
the bins of its own fixed pseudo-random sequence until one was filled, so equal sets agree.
The low eight bits of each value are stored; likeness subtracts the share of bins that
agree by chance.
"""

from __future__ import annotations

import numpy as np

from . import words as W

SHINGLE = 5
#: 512 bins of 8 bits: a standard error of about 0.02 at likeness 0.5.
BIN_BITS = 9
BINS = 1 << BIN_BITS
VALUE_BITS = 8
#: Texts whose bins are held at once.
ROWS = 2048
_EMPTY = np.uint64((1 << 64) - 1)


def _asks() -> np.ndarray:
    """Row a: whom each bin asks at its attempt a. After pseudo-random attempts each bin walks through all others."""
    bins = np.arange(BINS, dtype=np.uint64)
    random = [W.mix((bins + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(a << 32)) % np.uint64(BINS) for a in range(1, 2 * BINS)]
    walk = [(bins + np.uint64(a)) % np.uint64(BINS) for a in range(1, BINS)]
    return np.array(random + walk, np.int64)


_ASKS = _asks()


def signatures(part: W.Slice, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Low bits of each text's bins, one row a text, and which texts have no shingle."""
    hashes, bounds = W.shingles(W.words(part, W.SOLID), k)
    rows = [_bins(hashes[bounds[a] : bounds[min(a + ROWS, part.n)]], np.diff(bounds[a : a + ROWS + 1])) for a in range(0, part.n, ROWS)]
    return np.concatenate([np.zeros((0, BINS), np.uint8), *rows]), np.diff(bounds) == 0


def _bins(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Low bits of the bins of texts with so many hashes each."""
    n = len(counts)
    least = np.full(n * BINS, _EMPTY)
    place = np.repeat(np.arange(n) * BINS, counts) + (hashes >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    np.minimum.at(least, place, hashes & np.uint64((1 << (64 - BIN_BITS)) - 1))
    least = least.reshape(n, BINS)
    filled = least != _EMPTY
    row, column = np.nonzero(~filled & (counts > 0)[:, None])
    for asked in _ASKS:
        if not len(row):
            break
        target = asked[column]
        ok = filled[row, target]
        least[row[ok], column[ok]] = least[row[ok], target[ok]]
        row, column = row[~ok], column[~ok]
    return (least & np.uint64((1 << VALUE_BITS) - 1)).astype(np.uint8)


def to_text(values: np.ndarray, none: np.ndarray) -> list[str]:
    """Packed low bits in hexadecimal; a text without words has the empty string."""
    return ["" if e else v.tobytes().hex() for v, e in zip(values, none.tolist(), strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, none_a: np.ndarray, none_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity, row by row, chance agreement taken out. Two wordless texts: 1; one: 0."""
    chance = 1 / (1 << VALUE_BITS)
    out = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)
    return np.where(none_a | none_b, (none_a & none_b).astype(float), out)
