"""Best-fit packing of token sequences by large-item matching.

Lengths are whole numbers up to the capacity, so the plan is made from their histogram (at
most ``capacity`` rows on the driver, however many documents): items above one third of
the capacity go at most two to a bin by greedy matching, largest with the largest that
fits; the rest, in falling order, goes to the smallest gap that holds it. The plan is a
list of runs "items of this length, rank lo to hi, go to bins from b on at this offset";
tasks look their items' ranks up in it.
"""

from __future__ import annotations

import bisect
import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from ..store import cut

CAPACITY = 4096
#: The id that ends each document.
END_ID = 1
#: Units whose ids a worker keeps at most, about 60 MB; then it starts anew.
CACHE_WORDS = 1_000_000
#: Pieces of one length that are ranked in one window group, about.
RANK_GROUP = 500_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in "'<>|"]] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[0x61:0x7B] = True


class WordIds:
    """Ids of texts from the ids of their units, each different unit encoded once.

    The tokenizer lower-cases, drops white space, and breaks between white space and
    everything, and between a letter and punctuation other than an apostrophe. So a
    text's ids are those of its units in order: white-space separated runs, cut after letters that
    punctuation follows. Angle brackets and bars cut nothing, as special tokens hold them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int32)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _ids(self, chunks: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]

    def _word_ids(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for chunks that are one word each: encoded in one go, a word ends at an end-of-word token; one by one if those disagree."""
        ids = np.array([i for x in self._ids([b" ".join(chunks[k : k + 1000]) for k in range(0, len(chunks), 1000)]) for i in x], np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(chunks):
            each = self._ids(chunks)
            return np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each], np.int64)
        return ids, np.diff(ends, prepend=0)

    def _add(self, keys: np.ndarray, chunks: list[bytes], word: np.ndarray) -> None:
        ids, counts = self._word_ids([c for c, w in zip(chunks, word.tolist(), strict=True) if w])
        others = self._ids([c for c, w in zip(chunks, word.tolist(), strict=True) if not w])
        size = np.zeros(len(chunks), np.int64)
        size[word], size[~word] = counts, [len(x) for x in others]
        new = np.zeros(int(size.sum()), np.uint32)
        ours = np.repeat(word, size)
        new[ours], new[~ours] = ids, [i for x in others for i in x]
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(len(self.flat), np.uint32)))
        self.flat[self.used : self.used + len(new)] = new
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.first = np.insert(self.first, at, self.used + np.cumsum(size) - size)
        self.count = np.insert(self.count, at, size)
        self.used += len(new)

    def encode(self, part: W.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, each followed by END_ID, and where each text's begin."""
        data, raw = part.data, part.data.tobytes()
        low = data if b"<|" in raw else W.LOWER[data]
        solid = W.SOLID[data]
        letter = _LETTERS[W.LOWER[data]]
        lead = np.flatnonzero(data[:-1] == 0xC3)  # U+00C0 to U+00FF, all letters but two
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        letter[lead] = letter[lead + 1] = True
        cut_here, before = np.zeros(len(data), bool), np.zeros(len(data), bool)
        cut_here[1:] = _PUNCTUATION[data[1:]] & letter[:-1]
        before[1:] = solid[:-1]
        starts, ends = np.flatnonzero(solid & (~before | cut_here)), np.flatnonzero(before & (~solid | cut_here))
        keys, first, inverse = np.unique(W.hash_spans(low, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE_WORDS:
            self.clear()
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            a, b = starts[first[new]], ends[first[new]]
            letters = np.concatenate(([0], np.cumsum(letter)))
            self._add(keys[new], [raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], letters[b] - letters[a] == b - a)
            at = np.searchsorted(self.keys, keys)
        rows = at[inverse]
        counts = self.count[rows].astype(np.int64)
        ends_of = np.concatenate(([0], np.cumsum(counts)))
        ids = self.flat[np.arange(ends_of[-1]) + np.repeat(self.first[rows] - ends_of[:-1], counts)]
        bounds = ends_of[np.searchsorted(starts, part.offsets)]
        out = np.full(len(ids) + part.n, END_ID, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(part.n), np.diff(bounds))] = ids
        return out, bounds + np.arange(part.n + 1)


@functools.lru_cache(maxsize=1)
def _coder(path: str) -> WordIds:
    """One for all tasks that a Python worker runs."""
    return WordIds(path)


def token_pieces(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): each document's ids and END_ID, cut at ``capacity``."""
    path = path or tokenizer_path()
    shown = docs.select(F.col(id_column).alias("id"), W.text_column(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in batches:
            for part in W.slices(batch["text"]):
                ids, bounds = coder.encode(part)
                ids = ids.astype("<u4")
                sizes = np.diff(bounds)
                pieces = -(-sizes // capacity)
                doc = np.repeat(np.arange(part.n), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(sizes[doc] - start, capacity)
                at = bounds[doc] + start
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [batch["id"].take(pa.array(part.lo + doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, bounds[-1]).astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    kind = dict(docs.dtypes)[id_column]
    return shown.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Runs (length, rank lo, rank hi, first bin, offset), sorted, and the number of bins."""
    left = {s: n for s, n in histogram.items() if n}
    done = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []  # gaps that have bins, rising
    bins = 0

    def place(s: int, n: int, first: int, gap: int) -> None:
        runs.append((s, done[s], done[s] + n, first, capacity - gap))
        done[s] += n
        left[s] -= n

    def offer(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, n))

    sizes = sorted(left, reverse=True)
    large = sorted(s for s in sizes if 3 * s > capacity)
    for s in sizes:
        if 3 * s <= capacity:
            break
        while left[s]:
            at = bisect.bisect_right(large, min(capacity - s, s)) - 1
            while at >= 0 and not left[large[at]]:
                large.pop(at)
                at -= 1
            t = large[at] if at >= 0 else 0
            if t == s and left[s] == 1:
                at -= 1
                while at >= 0 and not left[large[at]]:
                    large.pop(at)
                    at -= 1
                t = large[at] if at >= 0 else 0
            n = left[s] if not t else left[s] // 2 if t == s else min(left[s], left[t])
            place(s, n, bins, capacity)
            if t:
                place(t, n, bins, capacity - s)
            offer(capacity - s - t, bins, n)
            bins += n
    for s in sizes:
        if 3 * s > capacity:
            continue
        while left[s]:
            at = bisect.bisect_left(order, s)
            if at < len(order):
                gap = order[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
            else:
                gap, first, n = capacity, bins, -(-left[s] // (capacity // s))
                bins += n
            each = gap // s
            full = min(n, left[s] // each)
            for k in range(each if full else 0):
                place(s, full, first, gap - k * s)
            offer(gap - each * s, first, full)
            some = left[s] if full < n and left[s] < each else 0
            for k in range(some):
                place(s, 1, first + full, gap - k * s)
            if some:
                offer(gap - some * s, first + full, 1)
                full += 1
            offer(gap, first + full, n - full)
    return np.array(sorted(runs), np.int64).reshape(-1, 5), bins


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (from :func:`token_pieces`) with sequence_id and offset: in a sequence, gapless from 0.

    Equal pieces, ties and null ids are placed like any other; an empty table gives an empty one.
    """
    pieces = cut(pieces)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan_bins(histogram, capacity)
    groups = max(1, sum(histogram.values()) // RANK_GROUP) * 8
    dealt = pieces.withColumn("deal", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(groups)))
    counts = dealt.groupBy("length", "deal").agg(F.count("*").alias("n"))
    before = counts.select("length", "deal", (F.sum("n").over(Window.partitionBy("length").orderBy("deal")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "deal").orderBy("id", "piece", "ids_crc32"))
    ranked = dealt.withColumn("inside", inside).join(before, ["length", "deal"]).withColumn("rank", F.col("before") + F.col("inside") - 1)
    plan = pieces.sparkSession.sparkContext.broadcast(runs)
    names = pieces.columns

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = plan.value
        most = runs[:, 2].max(initial=0) + 1
        keys = runs[:, 0] * most + runs[:, 1]
        for batch in batches:
            rank = batch["rank"].to_numpy()
            at = np.searchsorted(keys, batch["length"].to_numpy() * most + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(runs[at, 3] + rank - runs[at, 1]), pa.array(runs[at, 4])], [*names, "sequence_id", "offset"])

    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.select(*names, "rank").mapInArrow(look_up, schema)
