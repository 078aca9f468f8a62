"""Fingerprints of documents in falling order of id, each with its edited text's and its successor's likeness."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import numbered
from . import fingerprint as FP
from . import words as W

#: Documents to a range, about, and ranges at most.
RANGE_ROWS, MOST_RANGES = 4_000, 20_000
#: Cuts that an expression compares one by one.
FEW_CUTS = 100
#: Characters that a task gathers before it computes.
GATHER = 1 << 21


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint): one row per row; null text is empty, equal texts have equal fingerprints, wordless ones ''."""
    shown = docs.select(F.col(id_column), W.text_column(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch["text"]):
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.lo : part.hi], pa.array(FP.to_text(*FP.signatures(part)), pa.string())], [id_column, "fingerprint"])

    return shown.mapInArrow(run, f"`{id_column}` {dict(docs.dtypes)[id_column]}, fingerprint string")


def _as_slice(texts: list[str]) -> W.Slice:
    raw = [t.encode() + b"\n" for t in texts]
    return W.Slice(0, len(raw), np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw))))))


def edited_text(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: A null number's place among the cuts: below all others.
_NULL = np.iinfo(np.int64).min


def _range_of(number: Column, th: Column, cuts: list[tuple[int, int]]) -> Column:
    """How many of the sorted cuts (number, inverted text hash) are at or below a row: in generated code if they are few and split no number, else by binary search in Arrow batches."""
    if len(cuts) <= FEW_CUTS and all(t == _NULL for _, t in cuts):
        return sum((F.when(number >= c, 1).otherwise(0) for c, _ in cuts), F.lit(0))
    at = np.array([c for c, _ in cuts], np.int64)
    within = np.array([t for _, t in cuts], np.int64)

    def search(numbers: pa.Array, hashes: pa.Array) -> pa.Array:
        n = np.where(np.asarray(numbers.is_null()), _NULL, np.maximum(numbers.fill_null(0).to_numpy(), _NULL + 1))
        falling = ~hashes.to_numpy()
        low, high = np.searchsorted(at, n, "left"), np.searchsorted(at, n, "right")
        out = low.copy()
        for a, b in set(zip(low[high > low].tolist(), high[high > low].tolist(), strict=True)):
            mine = low == a
            out[mine] += np.searchsorted(within[a:b], falling[mine], "right")
        return pa.array(out.astype(np.int32))

    return F.arrow_udf(search, T.IntegerType())(number, th)


def _cuts(docs: DataFrame) -> list[tuple[int, int]]:
    """Where ranges of about RANGE_ROWS rows begin, at most twice MOST_RANGES; a number with more rows than a range (null too) is cut by text hash as well."""
    total = docs.count()
    n = min(MOST_RANGES, max(1, total // RANGE_ROWS))
    if n == 1:
        return []
    found = docs.agg(F.percentile_approx("number", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    cuts = {(c, _NULL) for c in found}
    rows = max(RANGE_ROWS, total // n)
    for r in docs.groupBy("number").count().where(F.col("count") > rows).collect():
        parts = -(-r["count"] // rows)
        number = _NULL if r["number"] is None else max(r["number"], _NULL + 1)
        cuts |= {(number, (k << 64) // parts + _NULL) for k in range(1, parts)}
    return sorted(cuts)


def _ranges(docs: DataFrame) -> DataFrame:
    """(r, last, id, number, th, text): documents dealt into ranges; each range ends (``last``) with the first row of the range below.

    Only ids and text hashes are read to choose the ranges; of each range the first row in order is sent to the range above.
    """
    spark = docs.sparkSession
    placed = docs.withColumn("r", _range_of(F.col("number"), F.col("th"), _cuts(docs)).cast("int"))
    order = F.struct(F.col("number").isNull().alias("none"), F.bitwise_not("number").alias("falling"), F.col("th"))
    heads = sorted((r["r"], r["head"]["falling"], r["head"]["th"]) for r in placed.groupBy("r").agg(F.min(order).alias("head")).collect())
    above = [heads[(i + 1) % len(heads)][0] for i in range(len(heads))]
    rows = [(None if f is None else ~f, th, up) for (_, f, th), up in zip(heads, above, strict=True)]
    sent = spark.createDataFrame(rows, "hnumber long, hth long, up int")
    doubled = placed.join(F.broadcast(sent), F.expr("number <=> hnumber and th = hth"), "left")
    both = F.when(F.col("up").isNull(), F.array(F.struct("r", F.lit(False).alias("last")))).otherwise(
        F.array(F.struct(F.col("r"), F.lit(False).alias("last")), F.struct(F.col("up").alias("r"), F.lit(True).alias("last")))
    )
    return doubled.select(F.explode(both).alias("p"), "id", "number", "th", "text").select("p.r", "p.last", "id", "number", "th", "text")


def fingerprint_chain(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next row is the one below in falling order of id, null ids last, then by text hash; after
    the last row comes the first. Ids may be of any type that sorts. Null text is empty. Repeated rows follow each other; many rows of
    one id, null too, are cut into ranges by their texts' hashes, rows that agree in both stay together. A
    single row is its own successor; an empty table gives no rows. Other columns are not read. A very long text and its
    edited one take some ten bytes a byte each.
    """
    shown, number = numbered(docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("th"), F.coalesce(F.col(text_column), F.lit("")).alias("text")), "id")
    shown = shown.withColumnRenamed(number, "number")
    dealt = _ranges(shown).repartition("r").sortWithinPartitions("r", "last", F.col("number").desc_nulls_last(), "th").drop("number", "th")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, follows = [], [], []  # follows[i]: texts[i] is a document and texts[i + 1] is its successor
        size, current = 0, None

        def compute() -> pa.RecordBatch:
            own = np.flatnonzero(follows)
            edited = [edited_text(texts[i], texts[i + 1]) for i in own.tolist()]
            values, none = FP.signatures(_as_slice(texts))
            evalues, enone = FP.signatures(_as_slice(edited))
            shown = FP.to_text(values[own], none[own])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in own.tolist()], id_type), pa.array([len(texts[i]) for i in own.tolist()], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                    pa.array(shown, pa.string()), pa.array(FP.to_text(evalues, enone), pa.string()),
                    pa.array(FP.likeness(values[own], evalues, none[own], enone)), pa.array(FP.likeness(values[own], values[own + 1], none[own], none[own + 1])),
                ],
                names,
            )

        for batch in batches:
            id_type = batch["id"].type
            for r, last, i, text in zip(batch["r"].to_pylist(), batch["last"].to_pylist(), batch["id"].to_pylist(), batch["text"], strict=True):
                if r != current:
                    current, ended = r, False
                    if follows:
                        follows[-1] = False
                elif ended:
                    continue
                ids.append(i)
                texts.append(text.as_py())
                follows.append(not last)
                ended = last
                size += len(texts[-1])
                if size > GATHER and len(texts) > 1:
                    tail = follows[-1]
                    follows[-1] = False
                    if any(follows):
                        yield compute()
                    ids, texts, follows, size = ids[-1:], texts[-1:], [tail], len(texts[-1])
        if follows:
            follows[-1] = False
            if any(follows):
                yield compute()

    names = [id_column, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kind = dict(docs.dtypes)[id_column]
    return dealt.mapInArrow(chain, f"`{id_column}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
