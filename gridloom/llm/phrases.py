"""Phrase collocation mining on vertical bitmaps: shift, AND, popcount.

A task turns some megabytes of text of one language into a shard: every word gets the bitmap of
the positions it stands at. Positions run on through the shard; between two pieces one position
stays empty, so no phrase crosses a border. Bitmaps are compressed: a word at more than one in 32
positions has packed bits, any other the sorted list of its positions. A phrase's
bitmap, shifted by one and ANDed with the next word's, is the longer phrase's; its popcount
is the count in the shard, and Spark sums popcounts over shards. What is rare in the whole corpus is not extended:
phrases whose words, then whose pairs, are frequent over all shards are told by bitmaps of hashes,
which let some others through but lose nothing; counts of what came through are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import cut, ranked
from . import words as W
from .sketch import in_bitmap, sized_bitmap

#: Bytes of text to a shard, about; a longer text is a shard of its own.
SHARD_BYTES = 4 << 20
#: A word at more than one in so many positions has packed bits.
DENSE = 32
LEAST, INSIDE, TOP = 10, 50, 2_000

_BREAK = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
_BLANK = np.isin(np.arange(256), np.frombuffer(b" \t", np.uint8))
_KIND = np.where(_BREAK, 2, np.where(_BLANK, 0, 1)).astype(np.int8)

_ONE = np.uint64(1)


def lang_key(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def shifted(bits: np.ndarray) -> np.ndarray:
    """Every position moved on by one."""
    out = bits << _ONE
    out[1:] |= bits[:-1] >> np.uint64(63)
    return out


def packed(positions: np.ndarray, length: int) -> np.ndarray:
    flags = np.zeros(-(-length // 64) * 64, bool)
    flags[positions] = True
    return np.packbits(flags, bitorder="little").view(np.uint64)


def unpacked(bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


class Shard:
    """Words of some texts of one language, and the bitmaps of their positions."""

    def __init__(self, part: W.Slice, lang: str):
        low = W.LOWER[part.data]
        kind = _KIND[low]
        edges = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        starts = np.concatenate((np.zeros(1, np.int64), edges))
        word = kind[starts] == 1
        starts, ends = starts[word], np.concatenate((edges, [len(kind)]))[word]
        piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
        hashes, first, at, self.counts = np.unique(W.hash_spans(low, starts, ends), return_index=True, return_inverse=True, return_counts=True)
        self.words = pa.array([low[a:b].tobytes().decode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], pa.string())
        self.hashes, self.marks = hashes, W.mix(hashes ^ lang_key(lang))
        place = np.arange(len(starts)) + np.cumsum(np.diff(piece, prepend=piece[:1]) > 0)
        #: The word at each position, -1 for none; two empty ones at the end. The sparse words' sorted lists, side by side.
        self.at = np.full((int(place[-1]) if len(place) else -1) + 3, -1, np.int32)
        self.at[place] = at
        #: Packed bits of the dense words.
        self.dense = {int(w): packed(place[at == w], len(self.at)) for w in np.flatnonzero(self.counts * DENSE > len(self.at))}
        self._is_dense = np.zeros(len(hashes) + 1, bool)
        self._is_dense[list(self.dense)] = True

    def pair_marks(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return W.mix(self.marks[one] * W._STEP + self.hashes[two])

    def _grouped(self, columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """Popcounts of the ANDs of shifted lists: the lists that meet are those of one word each, so equal rows are one phrase."""
        key = columns[0].astype(np.int64)
        for c in columns[1:2]:
            key = key * len(self.hashes) + c
        if len(columns) == 3:
            _, key = np.unique(key, return_inverse=True)
            key = key * len(self.hashes) + columns[2]
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        return [c[first] for c in columns], counts

    def phrases(self, frequent: Callable[[np.ndarray], np.ndarray] | None, follows: Callable[[np.ndarray, np.ndarray], np.ndarray], longest: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """(words by place, popcounts) of phrases of two words, then of three if ``longest`` is 3.

        A pair counts if ``follows`` (one, two) and both words are ``frequent``; a phrase of three if both its pairs count.
        """
        at, ok = self.at, np.ones(len(self.hashes) + 1, bool)
        if frequent is not None:
            ok[:-1] = frequent(self.marks)
        ok[-1] = False  # the empty position, word -1
        pair = np.zeros(len(at), bool)  # a pair that counts begins here
        start = np.flatnonzero(ok[at[:-1]] & ok[at[1:]])
        start = start[follows(at[start], at[start + 1])]
        pair[start] = True
        lists = start[~(self._is_dense[at[start]] & self._is_dense[at[start + 1]])]
        yield self._grouped([at[lists], at[lists + 1]])
        if longest > 2:
            third = lists[pair[lists + 1]]
            yield self._grouped([at[third], at[third + 1], at[third + 2]])
        for one, bits in self.dense.items():  # depth first, on packed bits
            moved = shifted(bits)
            for two, next_bits in self.dense.items():
                both = moved & next_bits
                n = int(np.bitwise_count(both).sum())
                if not (n and self._counts(one, two, ok, follows)):
                    continue
                yield [np.array([one]), np.array([two])], np.array([n])
                if longest > 2:
                    yield from self._third(one, two, shifted(both), ok, follows, pair)

    def _counts(self, one: int, two: int, ok: np.ndarray, follows) -> bool:
        return bool(ok[one] and ok[two] and follows(np.array([one]), np.array([two]))[0])

    def _third(self, one: int, two: int, moved: np.ndarray, ok: np.ndarray, follows, pair: np.ndarray):
        """Phrases of three that begin with two dense words whose bitmap, shifted, is ``moved``."""
        rest = moved
        for three, bits in self.dense.items():
            n = int(np.bitwise_count(moved & bits).sum())
            rest = rest & ~bits
            if n and self._counts(two, three, ok, follows):
                yield [np.array([w]) for w in (one, two, three)], np.array([n])
        spots = unpacked(rest)
        spots = spots[pair[spots - 1]]
        words, counts = self._grouped([self.at[spots]])
        yield [np.full(len(counts), one), np.full(len(counts), two), words[0]], counts

    def text(self, words: list[np.ndarray]) -> pa.Array:
        return pc.binary_join_element_wise(*[self.words.take(pa.array(w)) for w in words], pa.scalar(" "))


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Shard]]:
    """Shards of (lang, text) batches: by language within some megabytes of texts."""
    for batch in batches:
        for lang in pc.unique(batch["lang"]).to_pylist():
            mine = batch["text"].filter(pc.equal(batch["lang"], lang))
            for part in W.slices(mine, SHARD_BYTES):
                shard = Shard(part, lang)
                if len(shard.hashes):
                    yield lang, shard


def count_phrases(docs: DataFrame, least: int = LEAST, lang_column: str = "lang", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all single words, and (lang, phrase, k, f) of all phrases of k = 2 or 3 words with f >= ``least``.

    A null language is ``und``, a null text empty. Both frames are written to the shared folder.
    """
    spark = docs.sparkSession
    shown = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), W.text_column(text_column).alias("text"))

    def rows(lang: str, *columns: pa.Array, names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(columns[0]), np.int32)), pa.array([lang])).cast(pa.string()), *columns], ["lang", *names])

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, shard in shards(batches):
            yield rows(lang, shard.words, pa.array(shard.counts), pa.array(shard.marks.view(np.int64)), names=["phrase", "f", "mark"])

    words = cut(shown.mapInArrow(singles, "lang string, phrase string, f long, mark long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"), F.min("mark").alias("mark")))
    frequent, word_bits = sized_bitmap(words.where(F.col("f") >= least), "mark")
    shared_words = spark.sparkContext.broadcast(frequent)

    def word_ok(marks: np.ndarray) -> np.ndarray:
        return in_bitmap(shared_words.value, marks, word_bits)

    def hashed_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, shard in shards(batches):
            for (one, two), counts in shard.phrases(word_ok, lambda a, b: np.ones(len(a), bool), 2):
                yield pa.RecordBatch.from_arrays([pa.array(shard.pair_marks(one, two).view(np.int64)), pa.array(counts)], ["mark", "f"])

    marks = cut(shown.mapInArrow(hashed_pairs, "mark long, f long").groupBy("mark").agg(F.sum("f").alias("f")).where(F.col("f") >= least).select("mark"))
    pairs, pair_bits = sized_bitmap(marks, "mark")
    shared_pairs = spark.sparkContext.broadcast(pairs)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, shard in shards(batches):
            for found, counts in shard.phrases(None, lambda a, b, s=shard: in_bitmap(shared_pairs.value, s.pair_marks(a, b), pair_bits), 3):
                if len(counts):
                    yield rows(lang, shard.text(found), pa.array(np.full(len(counts), len(found), np.int32)), pa.array(counts), names=["phrase", "k", "f"])

    phrases = shown.mapInArrow(exact, "lang string, phrase string, k int, f long").groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return words.select("lang", "phrase", "f"), cut(phrases)


def mine_phrases(docs: DataFrame, least: int = LEAST, inside: int = INSIDE, top: int = TOP, lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """The first ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at blanks and tabs into words. Candidates are
    phrases of 2 or 3 words with a = f(phrase) >= ``least``. The cut into first part (l) and rest (r) with the lowest
    floor(1000000 a a / (l r)) counts, the earlier one of equals. A pair is dropped if some phrase of three around it has
    100 f >= ``inside`` a. Order: score, then a, falling, then the phrase's bytes. n: all words of the language. Null texts are empty, a null
    language is ``und``; repeated rows count each; ids and other columns are not read; without words there are no rows. A text
    longer than a shard takes some twenty bytes a byte.
    """
    words, found = count_phrases(docs, least, lang_column, text_column)
    parts = words.where(F.col("f") >= least).unionByName(found.select("lang", "phrase", "f"))
    ws = F.split("phrase", " ")
    first, rest = lambda k: F.array_join(F.slice(ws, 1, k), " "), lambda k: F.array_join(F.slice(ws, k + 1, 3), " ")
    cuts = found.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.when(F.col("k") == 2, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))).alias("cut"), "k")
    cuts = cuts.withColumn("first", F.when(F.col("cut") == 1, first(1)).otherwise(first(2))).withColumn("rest", F.when(F.col("cut") == 1, rest(1)).otherwise(rest(2)))
    left, right = parts.toDF("lang", "first", "l"), parts.toDF("lang", "rest", "r")
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    score = F.expr("(cast(1000000 as decimal(7,0)) * (wa * wa)) div (wl * wr)")
    valued = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumns({"wa": wide("a"), "wl": wide("l"), "wr": wide("r")}).select("lang", "phrase", "a", F.struct(score.alias("score"), "cut", "l", "r").alias("best"), F.lit(0).cast("long").alias("around"))
    none = F.lit(None)
    around = found.where("k = 3").select("lang", F.explode(F.array(first(2), rest(1))).alias("phrase"), none.cast("long").alias("a"), none.cast("struct<score:bigint,cut:int,l:bigint,r:bigint>").alias("best"), F.col("f").alias("around"))
    judged = valued.unionByName(around).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min("best").alias("best"), F.max("around").alias("around"))
    kept = cut(judged.where(100 * F.col("around") < inside * F.col("a")).select("lang", "phrase", "a", "best.l", "best.r", "best.score"))
    best = ranked(kept, F.desc("score"), F.desc("a"), F.asc("phrase"), within=("lang",)).where(F.col("rank") <= top)
    return best.join(words.groupBy("lang").agg(F.sum("f").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
