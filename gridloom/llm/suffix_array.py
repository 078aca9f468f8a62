"""Suffix arrays by induced sorting, in array steps, and their permuted common prefixes.

Suffixes are classified as smaller (S) or larger (L) than their successor. Leftmost S
suffixes (LMS) are put in order by sorting the substrings between them and, where those
repeat, by the suffix array of the shorter string of their names, whatever its alphabet; all
other suffixes are then induced from them in two linear scans. A scan takes as many entries at once as
do not write into each other's stretch, so its order is kept; where entries follow each other
too closely for arrays to pay it goes on one by one.
"""

from __future__ import annotations

import numpy as np

from .words import hash_spans

#: Entries that a scan takes at once, at most and at first.
MOST_AT_ONCE, FIRST_AT_ONCE = 1 << 16, 1 << 10
#: Stretches shorter than this are not worth array operations; then so many entries are taken one by one.
SHORT, ONE_BY_ONE = 24, 256


def _is_smaller(text: np.ndarray) -> np.ndarray:
    """Which suffixes are S. The empty suffix behind the text is the least, so the last one is L."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])  # places that differ from their successor
    rising = np.zeros(len(change) + 1, bool)
    rising[:-1] = text[change + 1] > text[change]
    out = rising[np.searchsorted(change, np.arange(n))]
    return out


def _scan(array: np.ndarray, text: np.ndarray, wanted: np.ndarray, free: np.ndarray) -> None:
    """Go through ``array`` upwards; each entry writes the suffix before it, if wanted, to its letter's next free place, which lies ahead.

    ``free`` moves along. Places without an entry hold -1.
    """
    n = len(array)
    p, width, singles = 0, FIRST_AT_ONCE, ONE_BY_ONE
    entry, letter, want, place = (memoryview(x) for x in (array, text, wanted, free))
    while p < n:
        stop = min(p + width, n)
        entries = array[p:stop]
        at = np.flatnonzero(entries > 0)
        before = entries[at] - 1
        keep = wanted[before]
        at, before = at[keep], before[keep]
        letters = text[before]
        order = np.argsort(letters, kind="stable")
        at, before, letters = at[order], before[order], letters[order]
        fresh = np.flatnonzero(np.concatenate(([True], letters[1:] != letters[:-1]))[: len(letters)])
        rank = np.arange(len(letters)) - np.repeat(fresh, np.diff(np.append(fresh, len(letters))))
        to = free[letters] + rank
        first = int(to.min()) if len(to) else n
        if first < stop:  # what lies from there on is not complete yet
            inside = at + p < first
            to, before, letters = to[inside], before[inside], letters[inside]
            stop = first
        array[to] = before
        free[letters] = to + 1  # ascending within a letter: the last one stays
        width = min(2 * max(width if stop - p == width else stop - p, SHORT), MOST_AT_ONCE)
        short = stop - p < SHORT
        p = stop
        if short:
            stop = min(p + singles, n)
            for i in range(p, stop):
                b = entry[i] - 1
                if b >= 0 and want[b]:
                    c = letter[b]
                    entry[place[c]] = b
                    place[c] += 1
            p, singles = stop, min(2 * singles, MOST_AT_ONCE)
        else:
            singles = ONE_BY_ONE


def _induce(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the LMS suffixes in (some) order that agrees with their first letters."""
    n = len(text)
    array = np.full(n, -1, np.int32)
    letters = text[lms]
    held = np.bincount(letters, minlength=len(ends))
    array[(ends - held)[letters] + np.arange(len(lms)) - (np.cumsum(held) - held)[letters]] = lms
    free = starts.copy()
    array[free[text[n - 1]]] = n - 1
    free[text[n - 1]] += 1
    _scan(array, text, ~smaller, free)
    array[np.arange(n) >= np.repeat(free, ends - starts)] = -1  # S suffixes are all induced anew
    _scan(array[::-1], text, smaller, n - ends)
    return array


def _first_eight(text: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on as one number, zeros behind the end."""
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out |= padded[k : k + len(text)].astype(np.uint64) << np.uint64(8 * k)
    return out


def _names(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings, rising with ``ordered`` and equal for equal ones, by their place in the text."""
    n = len(text)
    stop = np.minimum(np.append(lms[1:], n - 1) + 1, n)
    number = np.zeros(n, np.int32)
    number[lms] = np.arange(len(lms))
    at = number[ordered]
    size = (stop - lms).astype(np.int64)
    if text.dtype == np.uint8:  # short ones are told apart by their bytes as they are
        known = size <= 8
        digest = _first_eight(text)[lms] << (np.uint64(8) * np.maximum(8 - size, 0).astype(np.uint64))
        long = np.flatnonzero(~known)
        digest[long] = hash_spans(text, lms[long], stop[long])
    else:
        known = np.zeros(len(lms), bool)
        digest = hash_spans(text, lms, stop)
    size[-1] += n  # it ends with the text and equals no other
    fresh = np.ones(len(lms), bool)
    fresh[1:] = (digest[at[1:]] != digest[at[:-1]]) | (size[at[1:]] != size[at[:-1]])
    alike = np.flatnonzero(~fresh & ~known[at])
    if len(alike):  # equal hashes: compare letter by letter
        length = size[at[alike]]
        begin = np.cumsum(length) - length
        step = np.arange(begin[-1] + length[-1]) - np.repeat(begin, length)
        same = text[np.repeat(lms[at[alike]], length) + step] == text[np.repeat(lms[at[alike - 1]], length) + step]
        fresh[alike] = ~np.logical_and.reduceat(same, begin)
    names = np.empty(len(lms), np.int32)
    names[at] = np.cumsum(fresh) - 1
    return names


def _by_names(names: np.ndarray) -> np.ndarray:
    """The suffixes of the string of names in order, by its suffix array.

    A name that occurs once decides every comparison that reaches it, so names behind it that occur once
    too are left out of the recursion and take their places by name.
    """
    once = np.bincount(names)[names] == 1
    left_out = np.zeros(len(names), bool)
    left_out[1:] = once[1:] & once[:-1]
    kept = np.flatnonzero(~left_out)
    present = np.zeros(names.max() + 1, np.int32)
    present[names[kept]] = 1
    order = np.concatenate((kept[suffix_array((np.cumsum(present, dtype=np.int32) - 1)[names[kept]])], np.flatnonzero(left_out)))
    return order[np.argsort(names[order], kind="stable")]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The starts of all suffixes of ``text`` (bytes or names from 0 on) in order."""
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    counts = np.bincount(text)
    ends = np.cumsum(counts)
    starts = ends - counts
    smaller = _is_smaller(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + 1
    if len(lms) > 1:
        rough = _induce(text, smaller, lms[np.argsort(text[lms], kind="stable")], starts, ends)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        ordered = rough[is_lms[rough]]
        names = _names(text, lms, ordered)
        lms = ordered if names.max() + 1 == len(lms) else lms[_by_names(names)]
    return _induce(text, smaller, lms, starts, ends)


def common_prefixes(text: np.ndarray, array: np.ndarray, most: int) -> np.ndarray:
    """By place in the text: the length, up to ``most``, that a suffix shares with the one before it in order.

    Places whose predecessor in the text shares the letter before take one less than the place
    before them; only the others are compared, eight bytes at a time.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    here = np.arange(n)
    inside = (before > 0) & (here > 0)
    reducible = np.zeros(n, bool)
    reducible[inside] = text[here[inside] - 1] == text[before[inside] - 1]
    # a capped value tells nothing of the next place's, so no chain is longer than the cap
    start = np.flatnonzero(~reducible)
    words = _first_eight(text)

    def compare(places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(places), np.int64)
        live = np.flatnonzero(before[places] >= 0)
        for step in range(0, most, 8):
            a, b = places[live] + step, before[places[live]] + step
            ok = (a < n) & (b < n)
            live, a, b = live[ok], a[ok], b[ok]
            x = words[a] ^ words[b]
            same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3)
            same = np.minimum(same, n - np.maximum(a, b))
            out[live] += same
            live = live[same == 8]
        return np.minimum(out, most)

    out = np.zeros(n, np.int64)
    out[start] = compare(start)
    last = np.maximum.accumulate(np.where(reducible, 0, here))
    chained = out[last] - (here - last)
    unsure = reducible & (out[last] == most)
    out[reducible] = np.maximum(chained[reducible], 0)
    rest = np.flatnonzero(unsure)
    out[rest] = compare(rest)
    return out
