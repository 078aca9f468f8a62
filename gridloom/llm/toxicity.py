"""Toxicity by class-conditional Kneser-Ney models of letters in words.

Both classes' models share their backoff: the counts of each class speak only at the
longest context (six bytes, cut at the word's start), and what they leave over goes to
one interpolated Kneser-Ney model of shorter contexts over both classes' words, whose counts are
continuations: an n-gram counts by how many different bytes precede it. A rare
expression thus weighs no more than its class's own counts. A text's toxic and ordinary log-likelihoods are
compared per word; what decides is their length-normalised ratio, over all words and over those whose own
ratio is clear, with the strongest word's: a logistic curve fitted on labelled rows
that the counts have not seen makes a score of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import cut, drop_cut
from . import words as W

#: Labelled rows of each class that the model is fitted on at most, chosen by a hash of their id.
SAMPLE_PER_CLASS = 4_000
#: One labelled row in so many is kept from the counts and fits the curve.
CURVE_SHARE = 4
#: Bytes of the longest n-gram, the predicted one included.
ORDER = 7
#: Different words whose n-grams a worker counts at a time.
WORDS_AT_ONCE = 20_000
#: Words whose ratio a worker keeps at most, 12 bytes each.
CACHE_WORDS = 2_000_000


def _sequences(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' bytes with a space before and behind each; for each byte its place in its word and the word."""
    size = ends - starts + 2
    stop = np.cumsum(size)
    flat = np.full(stop[-1] if len(stop) else 0, 0x20, np.uint64)
    within = np.arange(len(flat), dtype=np.int32) - np.repeat((stop - size).astype(np.int32), size)
    word = np.repeat(np.arange(len(size), dtype=np.int32), size)
    letter = (within > 0) & (within < size[word] - 1)
    flat[letter] = data[(starts[word] + within - 1)[letter]]
    return flat, within, word


def _grams(flat: np.ndarray, within: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For n = 1 to ORDER: n, the last n bytes up to each place, and the n - 1 before that place, as one number each with the length in the top byte.

    Places with fewer bytes in their word before them hold what is not in a table.
    """
    value = np.zeros(len(flat), np.uint64)
    before = np.zeros(len(flat), np.uint64)
    for n in range(1, ORDER + 1):
        if n > 1:
            before[1:] = value[:-1]
            before |= np.uint64((n - 1) << 56)
        value[n - 1 :] |= flat[: max(len(flat) - n + 1, 0)] << np.uint64(8 * (n - 1))
        yield n, value | np.uint64(n << 56), before


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the longest n-gram at each place of the words, by class (not shared); and which n-grams of two bytes or more there are (shared)."""
    for whole in batches:
        for lo in range(0, whole.num_rows, WORDS_AT_ONCE):
            batch = whole.slice(lo, WORDS_AT_ONCE)
            offsets, data = W.string_buffers(batch["word"].cast(pa.large_binary()))
            flat, within, word = _sequences(data, offsets[:-1], offsets[1:])
            counts = [batch[c].to_numpy() for c in ("toxic", "ordinary")]
            longest = np.minimum(within + 1, ORDER)
            for n, gram, _ in _grams(flat, within):
                for shared in (False, True):
                    at = np.flatnonzero((within > 0) & ((within >= n - 1) if shared else (longest == n)))
                    if shared and n == 1:
                        continue
                    keys, inverse = np.unique(gram[at], return_inverse=True)
                    sums = [np.zeros(len(keys), np.int64) if shared else np.bincount(inverse, weights=c[word[at]], minlength=len(keys)).astype(np.int64) for c in counts]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), shared)), pa.array(keys.astype(np.int64)), *map(pa.array, sums)], ["shared", "gram", "toxic", "ordinary"])


@dataclass
class Table:
    keys: np.ndarray
    values: np.ndarray  # float32, one row a key

    def get(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros((len(keys), self.values.shape[1]), np.float32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys)[:, None], self.values[at], np.float32(0))


def _discount(counts: np.ndarray) -> float:
    once, twice = (counts == 1).sum(), (counts == 2).sum()
    return float(once / (once + 2 * twice)) if once and twice else 0.5


@dataclass
class Model:
    grams: Table  # toxic, ordinary count of the longest n-gram at hand
    contexts: Table  # toxic total, kinds, ordinary total, kinds
    shared: list[tuple[Table, Table, float]]  # by order: continuations; their total and kinds by context; discount
    discounts: tuple[float, float]

    @classmethod
    def fit(cls, words: DataFrame) -> Model | None:
        """From (word, toxic, ordinary), one row a word: n-grams and contexts are counted in Spark. None unless both classes have words."""
        grams = cut(words.mapInArrow(_count_grams, "shared boolean, gram long, toxic long, ordinary long").groupBy("shared", "gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))
        context = F.expr("shiftright(gram & (shiftleft(1L, 56) - 1), 8) | shiftleft(shiftrightunsigned(gram, 56) - 1, 56)").alias("context")
        without_first = F.expr("gram & (shiftleft(1L, cast(8 * (shiftrightunsigned(gram, 56) - 1) as int)) - 1) | shiftleft(shiftrightunsigned(gram, 56) - 1, 56)")
        continued = cut(grams.where("shared").groupBy(without_first.alias("gram")).agg(F.count("*").alias("toxic")).select(F.lit(True).alias("shared"), "gram", "toxic", F.lit(0).cast("long").alias("ordinary")))
        both = grams.where("not shared").unionByName(continued)
        totals = [x.cast("float").alias(n) for n, x in (("a", F.sum("toxic")), ("b", F.count_if(F.col("toxic") > 0)), ("c", F.sum("ordinary")), ("d", F.count_if(F.col("ordinary") > 0)))]
        counted = both.select("shared", "gram", F.col("toxic").cast("float"), F.col("ordinary").cast("float")).toArrow()
        above = both.groupBy("shared", context).agg(*totals).toArrow()
        drop_cut(continued)
        drop_cut(grams)

        def table(rows: pa.Table, n: int, columns: list[str]) -> Table:
            """Rows of the shared n-grams (n - 1 bytes of context), or for n = 0 of the longest ones."""
            keys = rows.column(1).to_numpy()
            of = rows.column("shared").to_numpy() == (n > 0)
            at = np.flatnonzero(of & (keys >> 56 == n - (rows is above)) if n else of)
            at = at[np.argsort(keys[at])]
            return Table(keys[at].astype(np.uint64), np.stack([rows[c].to_numpy()[at] for c in columns], 1))

        full = table(counted, 0, ["toxic", "ordinary"])
        if not (full.values > 0).any(axis=0).all():
            return None
        shared = []
        for n in range(1, ORDER):
            count = table(counted, n, ["toxic"])
            shared.append((count, table(above, n, ["a", "b"]), _discount(count.values)))
        return cls(full, table(above, 0, ["a", "b", "c", "d"]), shared, (_discount(full.values[:, 0]), _discount(full.values[:, 1])))

    def ratios(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-likelihood of each word in the toxic model less that in the ordinary one."""
        flat, within, word = _sequences(data, starts, ends)
        if not len(flat):
            return np.zeros(0, np.float32)
        longest = np.minimum(within + 1, ORDER)
        full, context = np.zeros(len(flat), np.uint64), np.zeros(len(flat), np.uint64)
        p = np.full(len(flat), 1 / 256)
        for n, gram, before in _grams(flat, within):
            top = (longest == n) & (within > 0)
            full[top], context[top] = gram[top], before[top]
            if n == ORDER:
                break
            grams, totals, d = self.shared[n - 1]
            use = np.flatnonzero(longest > n)
            count = grams.get(gram[use])[:, 0]
            total, kinds = totals.get(before[use]).T
            seen = total > 0
            use, count, total, kinds = use[seen], count[seen], total[seen], kinds[seen]
            p[use] = (np.maximum(count - d, 0) + d * kinds * p[use]) / total
        at = np.flatnonzero(within > 0)
        context, out = self.contexts.get(context[at]), np.zeros(len(at))
        live = np.flatnonzero(context.any(axis=1))  # else both models say what the shared one says
        context, full, p = context[live], full[at[live]], p[at[live]]
        counts = self.grams.get(full)
        logs = []
        for c in (0, 1):
            total, kinds, d = context[:, 2 * c], context[:, 2 * c + 1], self.discounts[c]
            logs.append(np.log(np.where(total > 0, (np.maximum(counts[:, c] - d, 0) + d * kinds * p) / np.maximum(total, 1), p)))
        out[live] = logs[0] - logs[1]
        return np.bincount(word[at], weights=out, minlength=len(starts)).astype(np.float32)


class _Known:
    """Ratios of the words that this worker has met."""

    def __init__(self, model: Model):
        self.model = model
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.float32)

    def of(self, w: W.Words) -> np.ndarray:
        keys, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE_WORDS:
            self.keys, self.values = self.keys[:0], self.values[:0]
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            values = self.model.ratios(w.low, w.starts[first[new]], w.ends[first[new]])
            place = np.searchsorted(self.keys, keys[new])
            self.keys, self.values = np.insert(self.keys, place, keys[new]), np.insert(self.values, place, values)
            at = np.searchsorted(self.keys, keys)
        return self.values[at[inverse]] if len(keys) else np.zeros(0, np.float32)


def _features(ratios: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """By text: ratio per word, the same of clear words only (what exceeds 2), and the strongest word's."""
    n = np.diff(bounds)
    most = np.zeros(len(n))
    some = np.flatnonzero(n)
    if len(some):
        most[some] = np.maximum.reduceat(ratios, bounds[:-1][some])
    sums = [np.concatenate(([0], np.cumsum(x, dtype=np.float64))) for x in (ratios, np.maximum(ratios - 2, 0))]
    mean, clear = ((s[bounds[1:]] - s[bounds[:-1]]) / np.maximum(n, 1) for s in sums)
    return np.stack([np.clip(mean * 20, -8, 8), np.log1p(clear * 200), np.clip(most, 0, 12) / 3], 1)


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a little shrinkage."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    b = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + 0.5 * b
        hessian = (x.T * (weight * p * (1 - p))) @ x + 0.5 * np.eye(len(b))
        b -= np.linalg.solve(hessian, gradient)
    return b


def _ready(column: str) -> F.Column:
    return F.lower(W.text_column(column))


@dataclass
class Scorer:
    """What a fit gives: the model and the curve; both bounded by the sample."""

    model: Model
    curve: np.ndarray

    def score(self, column: pa.Array) -> np.ndarray:
        out = []
        known = self.__dict__.setdefault("_known", _Known(self.model))  # lives as long as the broadcast in a worker
        for part in W.slices(column):
            w = W.words(part, W.ALNUM)
            x = _features(known.of(w), w.bounds)
            out.append(1 / (1 + np.exp(-np.clip(np.concatenate([x, np.ones((len(x), 1))], 1) @ self.curve, -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> Scorer | None:
    """Fit on at most ``per_class`` labelled rows of each class; None unless both classes have rows in both folds.

    Rows with null id, label or text are not learned from; of several labels of one id the least counts, of several texts that with
    the least hash.
    """
    given = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isin(0, 1)).select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("y"))
    usable = given.groupBy("id").agg(F.min("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.lit("sample"), "id")
    sample = usable.where("y = 0").orderBy(order).limit(per_class).unionByName(usable.where("y = 1").orderBy(order).limit(per_class))
    rows = docs.where(F.col(text_column).isNotNull()).select(F.col(id_column).alias("id"), _ready(text_column).alias("text")).join(F.broadcast(sample), "id")
    rows = rows.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = rows.withColumn("curve", F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(CURVE_SHARE)) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch["y"].to_numpy() == 1
            for part in W.slices(batch["text"]):
                w = W.words(part, W.ALNUM)
                keys, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
                mine = np.repeat(toxic[part.lo : part.hi], w.counts)
                text = [w.low[a:b].tobytes() for a, b in zip(w.starts[first].tolist(), w.ends[first].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(text, pa.binary()), pa.array(np.bincount(inverse[mine], minlength=len(keys))), pa.array(np.bincount(inverse[~mine], minlength=len(keys)))], ["word", "toxic", "ordinary"]
                )

    words = rows.where("not curve").select("y", "text").mapInArrow(count, "word binary, toxic long, ordinary long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    model = Model.fit(words)
    if model is None:
        return None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(shared.value)
        for batch in batches:
            for part in W.slices(batch["text"]):
                w = W.words(part, W.ALNUM)
                x = _features(known.of(w), w.bounds)
                yield pa.RecordBatch.from_arrays([batch["y"][part.lo : part.hi], *(pa.array(np.ascontiguousarray(c)) for c in x.T)], ["y", "a", "b", "c"])

    seen = rows.where("curve").select("y", "text").mapInArrow(describe, "y int, a double, b double, c double").toArrow()
    shared.destroy()
    y = seen["y"].to_numpy()
    if not 0 < y.sum() < len(y):
        return None
    weight = np.where(y == 1, sizes[1] / (y == 1).sum(), sizes[0] / (y == 0).sum())
    return Scorer(model, _curve(np.stack([seen[c].to_numpy() for c in "abc"], 1), y.astype(float), weight * len(y) / weight.sum()))


def score_toxicity(docs: DataFrame, scorer: Scorer | None, id_column: str = "doc_id", text_column: str = "text", keep: str | None = None) -> DataFrame:
    """Per row: id and score (0 to 1); with ``keep`` all columns of ``docs`` and the score under that name.

    Null text is scored like empty text, from the curve's offset alone. Rows are scored one by
    one, so repeated rows agree, and null ids and other columns do not matter. Without a scorer
    (no labels) every score is 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[tuple[pa.Array]]) -> Iterator[pa.Array]:
        for column in batches:
            if shared.value is None:
                yield pa.array(np.zeros(len(column)))
            else:
                yield pa.array(shared.value.score(column))

    score = F.arrow_udf(run, "double")(_ready(text_column))
    if keep:
        return docs.withColumn(keep, score)
    return docs.select(F.col(id_column), score.alias("score"))
