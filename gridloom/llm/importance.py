"""Importance resampling towards a target distribution, scored without exploding a text.

Features are all runs of one to three words, hashed into 10,000 buckets. The raw corpus and the
target each have a multinomial over the buckets; a bucket's gain is the log of their ratio, and
a document's weight is the sum of its features' gains. Higher-order functions make a
document's array of buckets and add up its gains from one literal array, so scoring is a
projection; what is shuffled is the buckets' totals, at most 10,000 rows a task. Drawing without
replacement is a sort by weight plus Gumbel noise that depends on seed and id alone.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import cut, ranked
from .sketch import counters

BUCKETS = 10_000
SEED, PERCENT, MIN_WORDS = 42, 5, 20

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z only; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BREAK), "")


def _bucket(*words: Column, buckets: int) -> Column:
    run = F.concat_ws(" ", *words) if len(words) > 1 else words[0]
    return (F.crc32(run.cast("binary")) % buckets).cast("int")


def buckets_of(words: str, buckets: int = BUCKETS) -> Column:
    """Buckets of all runs of one to three words of an array column, repeats included."""
    ws, all_ = F.col(words), F.size(words)
    one = F.transform(ws, lambda w: _bucket(w, buckets=buckets))
    two = F.transform(F.slice(ws, F.lit(2), all_), lambda w, i: _bucket(F.get(ws, i), w, buckets=buckets))
    three = F.transform(F.slice(ws, F.lit(3), all_), lambda w, i: _bucket(F.get(ws, i), F.get(ws, i + 1), w, buckets=buckets))
    return F.concat(one, two, three)


def bucket_totals(docs: DataFrame, text_column: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket: a task hands over its totals."""
    found = docs.select(words_of(F.col(text_column)).alias("ws")).select(F.explode(buckets_of("ws", buckets)).alias("bucket"))
    return counters(found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket", "n", buckets)


def gains(raw: np.ndarray, target: np.ndarray) -> list[int]:
    """Thousandths of the log of target over raw probability of each bucket, one added to each count, rounded down."""
    all_raw, all_target = float(raw.sum() + len(raw)), float(target.sum() + len(raw))
    return [math.floor(1000 * math.log((t + 1.0) * all_raw / ((s + 1.0) * all_target))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)]


def gumbel(id_: Column, seed: int = SEED) -> Column:
    """Thousandths of standard Gumbel noise from the first 32 bits of sha256(``seed:id``), rounded down; a null id is empty text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def importance_ranks(
    docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text", target_text: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS
) -> DataFrame:
    """Per row of ``docs``: id, th (xxhash64 of its text), n_words, n_features, weight, score, rank.

    Of the N rows with at least ``min_words`` words the floor(percent * N / 100) with the highest scores are drawn and have a
    rank from 1 on; the others' is null. Ties in score go to the smaller id (null last), then to the smaller
    text hash. Null and empty texts have no words, weight 0 and no rank unless ``min_words`` is 0; repeated rows are rows of
    their own, with places of their own. An empty table gives no rows; an empty target makes all gains depend on the raw
    counts alone. Other columns are not read. The words and buckets of one text are in memory at once,
    some forty bytes a byte of it.
    """
    raw, wanted = bucket_totals(docs, text_column, buckets), bucket_totals(target, target_text, buckets)
    gain = F.split(F.lit(",".join(map(str, gains(raw, wanted)))), ",").cast("array<bigint>")  # folded to one literal
    shown = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("th"), words_of(F.col(text_column)).alias("ws"))
    placed = shown.select("id", "th", F.size("ws").cast("long").alias("n_words"), buckets_of("ws", buckets).alias("bs"))
    weight = F.aggregate("bs", F.lit(0).cast("long"), lambda total, b: total + F.element_at(gain, b + 1))
    scored = placed.select("id", "th", "n_words", F.size("bs").cast("long").alias("n_features"), weight.alias("weight"))
    scored = cut(scored.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)).withColumn("row", F.monotonically_increasing_id()))
    open_ = F.col("n_words") >= min_words
    drawn = percent * scored.where(open_).count() // 100
    placed = ranked(scored.withColumn("closed", ~open_), F.asc("closed"), F.desc("score"), F.asc_nulls_last("id"), F.asc("th"), F.asc("row"))
    rank = F.when(~F.col("closed") & (F.col("rank") <= drawn), F.col("rank"))
    return placed.select(F.col("id").alias(id_column), "th", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def resampled(docs: DataFrame, ranks: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The drawn rows of ``docs``, whole, from :func:`importance_ranks` over the same rows; of rows with one id and text all stay if one is drawn."""
    drawn = ranks.where("rank is not null").select(F.col(id_column).alias("id"), "th").distinct()
    same = F.col(f"d.`{id_column}`").eqNullSafe(F.col("r.id")) & (F.xxhash64(F.col(f"d.`{text_column}`")) == F.col("r.th"))
    return docs.alias("d").join(drawn.alias("r"), same, "left_semi")
