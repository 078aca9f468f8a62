"""Quality rules: counts of a text's form, and a likelihood ratio between trusted and raw text.

Tokens are runs of letters and digits and runs of other signs. All single tokens and all pairs
of neighbours are hashed into 65,536 buckets. Two multinomials over the buckets, one counted over
all trusted documents and one over all documents, give each bucket a gain (the log of their
ratio); a text's score is the mean gain of its features, and a text whose mean is below the
threshold is rejected. Gains are whole millionths, so sums are exact and every run decides alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .sketch import counters, in_bitmap, sized_bitmap

#: Buckets of both multinomials: 512 KB each, whatever the data.
BUCKET_BITS = 16
#: Pseudo-count of a bucket in the trusted counts; the raw ones get the same share of theirs. It keeps rare tokens near 0.
SHRINK = 16
#: Mean gain in millionths below which a text is rejected.
THRESHOLD = -120_000
#: Base rules: fewer words fail, as do more repeated words per 100 words.
MIN_WORDS, MOST_REPEATED = 50, 50

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_FIRST = (np.arange(256) & 0xC0) != 0x80  # every byte but those that go on with a code point


def _runs(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of equal kinds other than 0; the last byte is of kind 0."""
    edges = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
    starts = np.concatenate((np.zeros(1, np.int64), edges))
    keep = kinds[starts] > 0
    return starts[keep], np.concatenate((edges, [len(kinds)]))[keep]


def feature_buckets(part: W.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all single tokens, of all pairs (-1 where a pair would cross texts), and the token where each text begins."""
    low = W.LOWER[part.data]
    starts, ends = _runs(np.where(W.ALNUM[part.data], 1, np.where(W.SOLID[part.data], 2, 0)).astype(np.int8))
    tokens = W.Words(low, starts, ends, W.hash_spans(low, starts, ends), np.searchsorted(starts, part.offsets))
    shift = np.uint64(64 - BUCKET_BITS)
    one = (tokens.hashes >> shift).astype(np.int32)
    two = (W.windows(tokens, 2) >> shift).astype(np.int32)
    last = tokens.bounds[1:-1] - 1  # last token of each text but the final one
    two[last[(last >= 0) & (last < len(two))]] = -1
    return one, two, tokens.bounds


def bucket_counts(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket: a task hands over its totals, at most 65,536 rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for part in W.slices(batch["text"]):
                one, two, _ = feature_buckets(part)
                held += np.bincount(one, minlength=len(held)) + np.bincount(two[two >= 0], minlength=len(held))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["key", "n"])

    return counters(docs.select(W.text_column(text_column).alias("text")).mapInArrow(count, "key long, n long"), "key", "n", 1 << BUCKET_BITS)


def fit_gains(raw: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    """Millionths of the log of trusted over raw probability of each bucket, rounded down; all 0 without trusted text."""
    share = float(trusted.sum()) / max(float(raw.sum()), 1.0)
    return np.array([math.floor(1_000_000 * math.log((t + SHRINK) / (share * s + SHRINK))) for s, t in zip(raw.tolist(), trusted.tolist(), strict=True)], np.int64)


def trusted_rows(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", label: Column | None = None) -> DataFrame:
    """Rows of ``docs`` with at least one label that trusts them (``quality`` 1); null ids have none.

    A bitmap of the trusted ids' hashes lets few other rows through, so only texts that count are shuffled for the join.
    """
    kind = docs.schema[id_column].dataType
    id_ = F.col(id_column).cast(kind)
    good = labels.where(F.col("quality") == 1 if label is None else label).where(id_.isNotNull()).select(id_.alias("trusted_id"), F.xxhash64(id_).alias("mark"))
    bitmap, bits = sized_bitmap(good, "mark")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def marked(keys: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(shared.value, keys.to_numpy().view(np.uint64), bits))

    maybe = docs.where(F.arrow_udf(marked, T.BooleanType())(F.xxhash64(id_column)))
    return maybe.join(good.hint("merge"), F.col(id_column) == F.col("trusted_id"), "left_semi")


def _form(part: W.Slice) -> list[np.ndarray]:
    """Of each text: words, code points in words, signs of ``[#*$%&|<>]``, repeated lines, words in repeated three-word windows."""
    data, cuts = part.data, part.offsets
    solid = W.SOLID[data]
    starts, ends = _runs(solid.view(np.int8))
    bounds = np.searchsorted(starts, cuts)
    n_words = np.diff(bounds)

    def total(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(flags), cuts))

    lines_end = np.flatnonzero(data == 0x0A)
    lines_start = np.concatenate((np.zeros(1, np.int64), lines_end[:-1] + 1))
    worded = np.searchsorted(starts, lines_end) > np.searchsorted(starts, lines_start)  # words end before line feeds
    lines_start, lines_end = lines_start[worded], lines_end[worded]
    repeated = np.zeros(len(lines_start), bool)
    later = _later(np.searchsorted(cuts, lines_start, "right"), W.hash_spans(data, lines_start, lines_end))
    repeated[later] = True
    n_dup = np.diff(np.concatenate(([0], np.cumsum(repeated)))[np.searchsorted(lines_start, cuts)])

    held = W.Words(data, starts, ends, W.hash_spans(data, starts, ends), bounds)
    hashes = W.windows(held, 3)
    doc = np.repeat(np.arange(part.n, dtype=np.int32), n_words)
    whole = np.flatnonzero(doc[: len(hashes)] == doc[2:]) if len(hashes) else np.zeros(0, np.int64)
    order = np.lexsort((hashes[whole], doc[whole]))
    key, of = hashes[whole][order], doc[whole][order]
    same = (key[1:] == key[:-1]) & (of[1:] == of[:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(starts) + 2, bool)
    at = whole[order[twice]]
    for step in range(3):
        covered[at + step] = True
    n_repeat = np.diff(np.concatenate(([0], np.cumsum(covered)))[bounds])
    return [n_words, total(solid & _FIRST[data]), total(_SYMBOL[data]), n_dup, n_repeat]


def _later(groups: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places whose key occurred before in their group."""
    order = np.lexsort((keys, groups))  # stable: equal ones stay in order of place
    same = (keys[order][1:] == keys[order][:-1]) & (groups[order][1:] == groups[order][:-1])
    return order[1:][same]


def judge_quality(docs: DataFrame, gains: np.ndarray, threshold: int = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_features, gain.

    base_failed: fewer than MIN_WORDS words, or more than MOST_REPEATED repeated words per 100; such rows are never kept. gain is
    the sum of the features' gains in millionths; other rows are kept if it is at least ``threshold`` times n_features. A null text is
    empty: no words, base_failed. Rows are judged one by one, so repeated rows agree, and null ids and
    other columns do not matter; an empty table gives an empty one. A text longer than a slice takes some twenty
    bytes a byte. Lines and windows of one text are compared by 64-bit hashes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    names = [id_column, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_features", "gain"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch["text"]):
                form = _form(part)
                one, two, bounds = feature_buckets(part)
                worth = np.zeros(len(one) + 1, np.int64)
                np.cumsum(shared.value[one], out=worth[1:])
                pairs = np.where(two >= 0, shared.value[two], 0)
                of_pairs, n_pairs = np.zeros(len(one) + 1, np.int64), np.zeros(len(one) + 1, np.int64)
                np.cumsum(pairs, out=of_pairs[1 : len(pairs) + 1])
                np.cumsum(two >= 0, out=n_pairs[1 : len(pairs) + 1])
                if len(one):
                    of_pairs[-1], n_pairs[-1] = of_pairs[-2], n_pairs[-2]  # the last token begins no pair
                gain = np.diff((worth + of_pairs)[bounds])
                n_features = np.diff(bounds) + np.diff(n_pairs[bounds])
                failed = (form[0] < MIN_WORDS) | (100 * form[4] > MOST_REPEATED * form[0])
                kept = ~failed & (gain >= threshold * n_features)
                columns = [*(pa.array(c.astype(np.int64)) for c in form), pa.array(failed), pa.array(kept), pa.array(n_features.astype(np.int64)), pa.array(gain)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.lo : part.hi], *columns], names)

    shown = docs.select(F.col(id_column), W.text_column(text_column).alias("text"))
    longs = ", ".join(f"{c} long" for c in names[1:6])
    return shown.mapInArrow(run, f"`{id_column}` {dict(docs.dtypes)[id_column]}, {longs}, base_failed boolean, kept boolean, n_features long, gain long")


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: int = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """:func:`judge_quality` of all rows, with gains from all of them and all that ``labels`` trust. Without trusted rows only the base rules decide."""
    raw = bucket_counts(docs, text_column)
    trusted = bucket_counts(trusted_rows(docs.select(id_column, text_column), labels, id_column), text_column)
    return judge_quality(docs, fit_gains(raw, trusted), threshold, id_column, text_column)
