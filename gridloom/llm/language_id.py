"""Language ID by multilingual mixture inference.

Each language has a table of byte trigrams of words. A document is a mixture of languages:
its words' likelihoods under each language come from their trigrams, and expectation
maximisation estimates the shares. The set of languages is the leading ones (1, 2, ... to all)
whose likelihood, less a penalty for each further language, is largest; larger sets are left
out only where a bound proves that they cannot win.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

#: Slots of a language's table: 256 KB each, whatever the data.
TABLE_BITS = 16
SMOOTHING = 0.5
STEPS = 12
#: Penalty for each language after the first (times the log of the number of words).
PENALTY = 3.0
#: A word's least likelihood relative to its best language.
FLOOR = np.float32(1e-30)

_LETTER = ((W._BYTES >= 0x41) & (W._BYTES <= 0x5A)) | ((W._BYTES >= 0x61) & (W._BYTES <= 0x7A)) | (W._BYTES >= 0x80)


def _trigrams(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Table slots of all trigrams that end in a word's letters or behind it, with blanks around words; and where each word's begin."""
    inside = np.zeros(len(w.low) + 2, np.int8)
    inside[w.starts] += 1
    inside[w.ends] -= 1
    inside = np.cumsum(inside, dtype=np.int8).astype(bool)
    byte = np.where(inside[: len(w.low)], w.low, 0x20).astype(np.uint32)
    one = np.concatenate((np.array([0x20], np.uint32), byte[:-1]))
    two = np.concatenate((np.array([0x20, 0x20], np.uint32), byte[:-2])) if len(byte) > 1 else np.full(len(byte), 0x20, np.uint32)
    two = np.where(one == 0x20, np.uint32(0x20), two)  # nothing of the word before
    slot = (((two << np.uint32(16)) | (one << np.uint32(8)) | byte) * np.uint32(2654435761)) >> np.uint32(32 - TABLE_BITS)
    size = w.ends - w.starts + 1
    stop = np.cumsum(size)
    at = np.arange(stop[-1] if len(stop) else 0) + np.repeat(w.starts - (stop - size), size)
    return slot[np.minimum(at, len(slot) - 1)].astype(np.int64), stop - size


def _ready(column: str) -> F.Column:
    return F.lower(W.text_column(column))


def fit_languages(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order of name and the log-probability of each slot (slots, languages), from all given rows.

    A task hands over its counts by language and slot. Rows with null text or language teach nothing.
    """
    shown = docs.where(F.col(text_column).isNotNull() & F.col(lang_column).isNotNull()).select(F.col(lang_column).alias("lang"), _ready(text_column).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch["lang"].to_pylist(), object)
            for part in W.slices(batch["text"]):
                w = W.words(part, _LETTER)
                slots, first = _trigrams(w)
                names, which = np.unique(langs[part.lo : part.hi].astype(str), return_inverse=True)
                of_word = np.repeat(which, w.counts)
                of_slot = np.repeat(of_word, np.diff(np.append(first, len(slots))))
                table = np.bincount((of_slot << TABLE_BITS) + slots, minlength=len(names) << TABLE_BITS).reshape(len(names), -1)
                for name, row in zip(names.tolist(), table, strict=True):
                    held[name] = held.get(name, 0) + row
        for name, row in held.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(row[at])], ["lang", "slot", "n"])

    rows = shown.mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows["lang"].to_pylist()))
    table = np.full((1 << TABLE_BITS, len(langs)), SMOOTHING)
    column = np.searchsorted(np.array(langs, object).astype(str), np.array(rows["lang"].to_pylist(), object).astype(str)) if langs else np.zeros(0, np.int64)
    table[rows["slot"].to_numpy(), column] += rows["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def _expect(word: np.ndarray, share: np.ndarray, doc: np.ndarray, bounds: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares by text after so many steps, and each text's log-likelihood under them (relative to its words' best)."""
    n = np.diff(bounds)[:, None]
    for _ in range(steps):
        joint = word * share[doc]
        joint /= joint.sum(axis=1, keepdims=True)
        share = np.add.reduceat(joint, bounds[:-1], axis=0) / n
    return share, np.add.reduceat(np.log((word * share[doc]).sum(axis=1)), bounds[:-1], dtype=np.float64)


def _most(word: np.ndarray, share: np.ndarray, doc: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """What no shares of any languages can exceed as a text's log-likelihood.

    The log-likelihood is concave in the shares, so others gain at most its largest slope less the slope along
    these, which is the number of words. As words are relative to their best, it is not above 0 either.
    """
    given = (word * share[doc]).sum(axis=1)
    slope = np.add.reduceat(word / given[:, None], bounds[:-1], axis=0, dtype=np.float64).max(axis=1)
    return np.minimum(0, np.add.reduceat(np.log(given), bounds[:-1], dtype=np.float64) + np.maximum(slope - np.diff(bounds), 0))


def mixture(word: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Shares of each text's languages (0: not in its set). word: likelihoods of words by language, 1 for the best; counts: words of each text, none 0."""
    word = np.maximum(word, FLOOR)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    doc = np.repeat(np.arange(len(counts)), counts)
    languages = word.shape[1]
    share, _ = _expect(word, np.full((len(counts), languages), 1 / languages, np.float32), doc, bounds, STEPS)
    lead = share.argmax(axis=1)
    chosen = np.zeros_like(share)
    chosen[np.arange(len(counts)), lead] = 1
    if languages == 1:
        return chosen
    value = np.add.reduceat(np.log(word[np.arange(len(word)), lead[doc]]), bounds[:-1], dtype=np.float64)
    most = _most(word, share, doc, bounds)
    open_ = np.arange(len(counts))
    for size in range(2, languages + 1):
        stay = most[open_] - PENALTY * (size - 1) * np.log(counts[open_] + 1) > value[open_]  # else no set of so many or more can win
        if not stay.any():
            break
        if size == 2 or not stay.all():
            word, open_, share = word[stay[doc]], open_[stay], share[stay]
            n = counts[open_]
            bounds = np.concatenate(([0], np.cumsum(n)))
            doc = np.repeat(np.arange(len(n)), n)
            rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
        within = np.where(rank < size, np.maximum(share, 1e-6), 0).astype(np.float32)
        fit, likelihood = _expect(word, within / within.sum(axis=1, keepdims=True), doc, bounds, STEPS // 2)
        worth = likelihood - PENALTY * (size - 1) * np.log(n + 1)
        better = worth > value[open_]
        chosen[open_[better]], value[open_[better]] = fit[better], worth[better]
    return chosen


#: Words whose trigrams are looked up at once.
WORDS_AT_ONCE = 1 << 17


def likelihoods(table: np.ndarray, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each word's likelihood by language, 1 for its best; only some words' slots by language are held at once."""
    out = np.empty((len(first), table.shape[1]), table.dtype)
    for a in range(0, len(first), WORDS_AT_ONCE):
        b = min(a + WORDS_AT_ONCE, len(first))
        stop = first[b] if b < len(first) else len(slots)
        logs = np.add.reduceat(table[slots[first[a] : stop]], first[a:b] - first[a], axis=0)
        out[a:b] = np.exp(logs - logs.max(axis=1, keepdims=True))
    return out


def identify_languages(docs: DataFrame, langs: list[str], table: np.ndarray, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score (its share of the text's words) and languages (those in the text's set, by share).

    Texts that are null or have no letter are ``und`` with score 0 and no languages, as is every text
    if no language was learned. Ties go to the language first in order of name. Rows are judged one by
    one; repeated rows agree; null ids and other columns do not matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lettered = batch["lettered"].to_numpy(zero_copy_only=False)
            for part in W.slices(batch["text"]):
                w = W.words(part, _LETTER)
                counts = w.counts
                pred, score = np.full(part.n, "und", object), np.zeros(part.n)
                sets: list[list[str]] = [[] for _ in range(part.n)]
                use = np.flatnonzero((counts > 0) & lettered[part.lo : part.hi])
                if len(use) and langs:
                    slots, first = _trigrams(w)
                    word = likelihoods(shared.value, slots, first)
                    mine = np.repeat((counts > 0) & lettered[part.lo : part.hi], counts)
                    share = mixture(word[mine], counts[use])
                    lead = share.argmax(axis=1)
                    for d, row, i in zip(use.tolist(), share, lead.tolist(), strict=True):
                        pred[d], score[d] = langs[i], min(1.0, float(row[i]))
                        sets[d] = [langs[j] for j in np.argsort(-row, kind="stable").tolist() if row[j] > 0]
                rows = slice(part.lo, part.hi)
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(sets, pa.list_(pa.string()))], [id_column, "lang_pred", "score", "languages"])

    shown = docs.select(F.col(id_column), _ready(text_column).alias("text"), F.coalesce(F.col(text_column).rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return shown.mapInArrow(run, f"`{id_column}` {dict(docs.dtypes)[id_column]}, lang_pred string, score double, languages array<string>")
