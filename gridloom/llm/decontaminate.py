"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark item is cut into windows of ten consecutive words; a window is a set of
three-word shingles. Shingles are ordered by rarity, counted over all documents. For
exact containment one prefix token, the window's rarest shingle, is necessary and enough:
documents emit only shingles that are prefix tokens of some window (a fixed-size bitmap
tells), the tokens are joined, the window's place is bounded by length and position, and
the words are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .sketch import bitmap_of, count_batch, in_bitmap
from ..store import cut

#: Words in a window and in a shingle.
WINDOW, SHINGLE = 10, 3


def _item_windows(items: DataFrame, id_column: str, text_column: str, window: int, q: int) -> DataFrame:
    """(item, win, n, off, h): each window's words joined by spaces and each of its shingles."""
    shown = items.select(F.col(id_column).alias("item"), W.text_column(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["item"].to_pylist()
            for part in W.slices(batch["text"]):
                w = W.words(part, W.ALNUM)
                item, win, size, off, key = [], [], [], [], []
                for d in range(part.n):
                    a, b = int(w.bounds[d]), int(w.bounds[d + 1])
                    n = min(window, b - a)
                    if n == 0:
                        continue
                    k = min(q, n)
                    for s in range(a, b - n + 1):
                        text = b" ".join(w.low[x:y].tobytes() for x, y in zip(w.starts[s : s + n], w.ends[s : s + n], strict=True)).decode()
                        for j in range(n - k + 1):
                            item.append(ids[part.lo + d])
                            win.append(text)
                            size.append(n)
                            off.append(j)
                            key.append(int(W.sequence_hash(w.hashes[s + j : s + j + k]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(item, batch["item"].type), pa.array(win, pa.string()), pa.array(size, pa.int32()), pa.array(off, pa.int32()), pa.array(key, pa.int64())], ["item", "win", "n", "off", "h"])

    kind = dict(items.dtypes)[id_column]
    return shown.mapInArrow(run, f"item {kind}, win string, n int, off int, h long")


def _marked(w: W.Words, lengths: list[int], bitmap: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and hashes of the shingles of each length that the bitmap lets through."""
    left = np.repeat(w.bounds[1:], w.counts) - np.arange(len(w.hashes))
    for k in lengths:
        h = W.windows(w, k)
        at = np.flatnonzero(in_bitmap(bitmap, h) & (left[: len(h)] >= k))
        yield at, h[at]


def contamination(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", window: int = WINDOW, shingle: int = SHINGLE
) -> DataFrame:
    """One row per document: id, th (hash of its text), n_words, n_hit, items (sorted array of item ids as strings).

    A window: ``window`` consecutive words of an item, or all words of an item that has
    fewer. A document word inside any occurrence of a window is hit. Null and wordless
    texts have no words and no hits; items with null id are ignored, wordless items have no window,
    repeated items count once. Rows are judged one by one: repeated rows each get the same
    answer. Other columns are not read. Empty tables give no rows or no hits.
    """
    sc = docs.sparkSession.sparkContext
    shingles = cut(_item_windows(items.where(F.col(item_column).isNotNull()), item_column, item_text_column, window, shingle))
    lengths = sorted(r[0] for r in shingles.select(F.least("n", F.lit(shingle))).distinct().collect())
    shown = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("th"), W.text_column(text_column).alias("text"))
    wanted = sc.broadcast(bitmap_of(shingles, "h"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.zeros(0, np.uint64)]
        for batch in batches:
            for part in W.slices(batch["text"]):
                w = W.words(part, W.ALNUM)
                found += [h for _, h in _marked(w, lengths, wanted.value)]
            if sum(map(len, found)) > 1 << 20:
                yield count_batch(np.concatenate(found).view(np.int64))
                found = [np.zeros(0, np.uint64)]
        yield count_batch(np.concatenate(found).view(np.int64))

    counts = shown.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("seen"))
    rare = F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "h", "off")).alias("rare")
    prefixes = (
        shingles.join(counts, F.col("h") == F.col("key"), "left").groupBy("item", "win", "n").agg(rare).where("rare.seen > 0").select("item", "win", "n", F.col("rare.h").alias("h"), F.col("rare.off").alias("off"))
    )
    prefixes = cut(prefixes)
    chosen = sc.broadcast(bitmap_of(prefixes, "h"))
    reach = window

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch["text"]):
                w = W.words(part, W.ALNUM)
                places, hashes, contexts, before = [], [], [], []
                for at, h in _marked(w, lengths, chosen.value):
                    places.append(at)
                    hashes.append(h)
                at, h = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, hashes))
                order = np.argsort(at, kind="stable")
                at, h = at[order], h[order].astype(np.uint64)
                doc = np.searchsorted(w.bounds, at, "right") - 1
                lo = np.maximum(w.bounds[doc], at - reach)
                hi = np.minimum(w.bounds[doc + 1], at + reach)
                for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                    contexts.append(b" ".join(w.low[x:y].tobytes() for x, y in zip(w.starts[a:b].tolist(), w.ends[a:b].tolist(), strict=True)).decode())
                before = (at - lo).astype(np.int32)
                hits = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(at - w.bounds[doc]), pa.array(before), pa.array(contexts, pa.string())], ["h", "pos", "before", "context"])
                ends = np.searchsorted(at, w.bounds)
                rows = slice(part.lo, part.hi)
                yield pa.RecordBatch.from_arrays(
                    [batch["id"][rows], batch["th"][rows], pa.array(w.counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), hits)], ["id", "th", "n_words", "hits"]
                )

    kind = dict(docs.dtypes)[id_column]
    probed = cut(shown.mapInArrow(probe, f"id {kind}, th long, n_words long, hits array<struct<h: long, pos: long, before: int, context: string>>"))
    tokens = probed.where(F.size("hits") > 0).select("id", "th", "n_words", F.explode("hits").alias("hit")).distinct()
    start = F.col("pos") - F.col("off")
    verified = (
        tokens.select("id", "th", "n_words", "hit.*")
        .join(prefixes, "h")
        .where((start >= 0) & (start + F.col("n") <= F.col("n_words")))
        .where(F.array_join(F.slice(F.split("context", " "), F.col("before") - F.col("off") + 1, F.col("n")), " ") == F.col("win"))
        .select("id", "th", start.alias("a"), (start + F.col("n")).alias("b"), F.col("item").cast("string").alias("item"))
    )
    runs = F.array_sort(F.collect_set(F.struct("a", "b")))
    covered = F.aggregate(
        "runs", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], acc["reach"]))).alias("n"), F.greatest(acc["reach"], x["b"]).alias("reach")),
    )["n"]
    hit = verified.groupBy("id", "th").agg(runs.alias("runs"), F.array_sort(F.collect_set("item")).alias("items")).select("id", "th", covered.alias("n_hit"), "items")
    return (
        probed.alias("d")
        .join(hit.alias("h"), F.expr("d.id <=> h.id and d.th = h.th"), "left")
        .select(F.col("d.id").alias(id_column), "d.th", "d.n_words", F.coalesce("h.n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("h.items", F.array().cast("array<string>")).alias("items"))
    )
