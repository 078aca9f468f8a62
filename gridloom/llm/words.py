"""Vectorised words and shingles of Arrow text batches.

All helpers work on small slices of whole texts; a slice never splits a text, and of a text longer
than a slice words and hashes take some ten bytes a byte. Each
text must end in a byte that is no word byte (``text_column`` adds a line feed).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts are handled in slices of about this many bytes, which bounds the temporaries.
SLICE_BYTES = 1 << 20

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
LOWER = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z: digits, letters, all bytes from 0x80.
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | _UPPER | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
#: [^\x20\x09-\x0D]
SOLID = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))

_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1


def text_column(name: str) -> Column:
    """The text as the helpers want it: null is empty, one line feed at the end."""
    return F.concat(F.coalesce(F.col(name), F.lit("")), F.lit("\n"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the odd base modulo 2**64 and of its inverse, as many as were asked for."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, SLICE_BYTES + (1 << 18))
            base = np.full(size, _BASE & _MASK, np.uint64)
            base[0] = 1
            inverse = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            inverse[0] = 1
            cls.up, cls.down = np.cumprod(base), np.cumprod(inverse)
        return cls.up[:n], cls.down[:n]


@dataclass
class Slice:
    """Some whole texts of a batch: rows ``lo``..``hi`` of it, their bytes, and where each begins."""

    lo: int
    hi: int
    data: np.ndarray  # uint8, unchanged
    offsets: np.ndarray  # int64, one more than texts

    @property
    def n(self) -> int:
        return self.hi - self.lo


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array without nulls; no copy of the bytes."""
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    offsets, data = string_buffers(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield Slice(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    """Words of a slice: where each starts and ends, its 64-bit hash, and each text's first word."""

    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  # word index where each text begins, one more than texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of the bytes. Spans in order are taken a slice at a time, so temporaries stay small in long texts."""
    if len(data) > 2 * SLICE_BYTES and len(starts):
        out, a = np.empty(len(starts), np.uint64), 0
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(starts, starts[a] + SLICE_BYTES)))
            lo, hi = int(starts[a]), int(ends[a:b].max())
            if lo == 0 and hi == len(data):
                break  # one span from end to end
            out[a:b] = hash_spans(data[lo:hi], starts[a:b] - lo, ends[a:b] - lo)
            a = b
        if a == len(starts):
            return out
    up, down = _Powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(part: Slice, kind: np.ndarray) -> Words:
    """Runs of bytes of ``kind`` (ALNUM or SOLID), A-Z lower-cased."""
    low = LOWER[part.data]
    inside = kind[part.data].view(np.int8)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate(([0], edges))
    starts, ends = edges[0::2], edges[1::2]
    return Words(low, starts, ends, hash_spans(low, starts, ends), np.searchsorted(starts, part.offsets))


def windows(w: Words, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each word on, whatever text they are in."""
    n = max(len(w.hashes) - k + 1, 0)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * _STEP + w.hashes[j : j + n]
    return mix(out)


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """The hash that :func:`windows` gives a window of exactly these words."""
    out = np.full(1, len(hashes), np.uint64)
    for h in hashes:
        out = out * _STEP + h
    return mix(out)[0]


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All ``k``-word shingles in order of place, and where each text's begin.

    A text of fewer words, but not none, has its whole sequence as its only shingle.
    """
    total = len(w.hashes)
    counts = w.counts
    valid = np.zeros(total, bool)
    out = np.zeros(total, np.uint64)
    full = windows(w, k)
    out[: len(full)] = full
    left = np.repeat(w.bounds[1:], counts) - np.arange(total)
    np.greater_equal(left, k, out=valid)
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        a, b = w.bounds[d], w.bounds[d + 1]
        out[a] = sequence_hash(w.hashes[a:b])
        valid[a] = True
    where = np.flatnonzero(valid)
    return out[where], np.searchsorted(where, w.bounds)


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and where each text's begin. Reorders ``values``."""
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[bounds[:-1][np.diff(bounds) > 0]] = True
    return values[keep], np.concatenate(([0], np.cumsum(keep)))[bounds]
