"""Suffix-array dedup: remove bytes covered by 50-byte strings that start in an earlier document too.

Each 50-byte string is keyed by the least hash of the 18-byte grams in it, which depends on
its bytes alone, so equal strings share a key; neighbouring strings mostly share one too
and travel as one segment. A first pass finds the keys that two documents have (a bitmap of
fixed size); a second sends the segments with such keys to shards by key. A shard sorts the
suffixes of its distinct segments by induction (but for those alone with their key), takes equal 50-byte strings from the
permuted common prefixes, and finds for each the smallest document. Candidates are
only narrowed by keys; the suffix arrays decide.

Keys that many documents have would fill a shard with their documents. Their segments are
first collapsed, in tasks and by a partial aggregation, to one row a segment with its smallest and
largest document; shards sort these alone, and what they find is joined back to the documents, a
join that adaptive execution can split. Keys that still have many different segments (a common
gram in changing surroundings) are dealt on: their segments are cut into runs by the least hash of
longer grams, in the end of the 50-byte strings themselves, until every shard is small. Of the runs
only those go on whose key two segments have (a bitmap again); the strings of the others are their segment's own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import cut, numbered
from . import words as W
from .suffix_array import common_prefixes, suffix_array

LENGTH, GRAM = 50, 18
#: Bits of the bitmap of repeated keys: 16 MB whatever the data. A full one costs time, never results.
KEY_BITS = 27
#: Bytes of text after which a task hands over the keys, and the segments, that it has gathered.
KEYS_BYTES, SEGMENTS_BYTES = 24 << 20, 6 << 20
#: Distinct bytes that one suffix array takes; more are cut between keys. Twice as many bytes of segments are solved at once.
ARRAY_BYTES = 2 << 20
#: Documents, or segments (of 115 bytes at most) in two documents or more, from which a key is hot, and bits of the bitmap that marks
#: hot keys: 2 MB whatever the data. A key marked by another one's bit takes the same way; that costs time, never results. So no key
#: brings more than 230 KB to a shard, nor more than ``MOST_CROWD`` segments to one of hot keys: one suffix array never takes more
#: than ``ARRAY_BYTES`` and that.
HOT_DOCS, HOT_SEGMENTS, HOT_BITS = 256, 2048, 24
#: A hot key is dealt on by longer grams if it has more different segments than an even share of a shuffle partition,
#: or, once cut, a quarter of it; taken within these bounds.
CROWD, MOST_CROWD = 256, 16_384
#: Segments of crowded keys (of 115 bytes at most) from which a task gathers the keys of longer grams.
GATHERED = 16_384


def _part_bits(spark: SparkSession) -> int:
    """Parts of the key space, as a power of two: some four to each shuffle partition."""
    return min(20, max(4, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))


def _longer_grams(length: int, gram: int) -> list[int]:
    """By what lengths of grams crowded keys are dealt on; the last is the string itself, of which no two different ones share a shard."""
    return sorted({(gram + 3 * length) // 4, length})


def _gram_keys(data: np.ndarray, gram: int) -> np.ndarray:
    at = np.arange(max(len(data) - gram + 1, 0))
    return W.hash_spans(data, at, at + gram)


def _runs(part: W.Slice, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one key: first start, last start (places in the slice) and key.

    A gram that recurs within a string's length makes endless runs; they are cut after twice the strings that one gram's place can rule.
    """
    none = np.zeros(0, np.int64)
    data, n = part.data, len(part.data)
    if n > 2 * W.SLICE_BYTES and part.n == 1:  # a run that goes on in the next piece becomes two
        found = []
        for lo in range(0, n - length, W.SLICE_BYTES):
            hi = min(lo + W.SLICE_BYTES + length - 1, n - 1)
            first, last, key = _runs(W.Slice(0, 1, data[lo:hi], np.array([0, hi - lo + 1])), length, gram)
            found.append((first + lo, last + lo, key))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
    count = n - length + 1
    if count <= 0:
        return none, none, none.view(np.uint64)
    grams, width = _gram_keys(data, gram), length - gram + 1
    padded = np.concatenate((grams, np.full(-len(grams) % width, np.uint64((1 << 64) - 1)))).reshape(-1, width)
    rising = np.minimum.accumulate(padded, axis=1).ravel()
    falling = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(falling[:count], rising[width - 1 : width - 1 + count])
    ends = np.repeat(part.offsets[1:] - 1, np.diff(part.offsets))  # without the line feed
    valid = np.arange(count) + length <= ends[:count]
    joined = np.zeros(count + 1, bool)
    joined[1:-1] = valid[1:] & valid[:-1] & (least[1:] == least[:-1])
    first, last = np.flatnonzero(valid & ~joined[:-1]), np.flatnonzero(valid & ~joined[1:])
    most = 2 * width
    pieces = (last - first) // most + 1
    if len(pieces) and pieces.max() > 1:
        run = np.repeat(np.arange(len(first)), pieces)
        first = first[run] + most * _spread(np.zeros(len(pieces), np.int64), pieces)
        last = np.minimum(first + most - 1, last[run])
    return first, last, W.mix(least[first] ^ np.uint64(0x5851F42D4C957F2D))


def _blobs(part: np.ndarray, columns: dict[str, np.ndarray], payload: tuple[np.ndarray, np.ndarray] | None = None) -> pa.RecordBatch:
    """One row a part: the values of each column for it, as bytes. ``part`` is sorted; payload: bytes and where each entry's begin."""
    found, first = np.unique(part, return_index=True)
    stop = np.append(first, len(part))[1:]
    arrays = [pa.array(found.astype(np.int32))]
    arrays += [pa.array([v[a:b].tobytes() for a, b in zip(first.tolist(), stop.tolist(), strict=True)], pa.binary()) for v in columns.values()]
    if payload:
        data, at = payload
        arrays.append(pa.array([data[a:b].tobytes() for a, b in zip(at[first].tolist(), at[stop].tolist(), strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, ["part", *columns, *["bytes"] * bool(payload)])


def _repeated_keys(shown: DataFrame, length: int, gram: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the keys that two rows have and of the hot ones, by the keys' top bits."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, again, size = [], [], 0

        def hand_over() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            more = np.zeros(len(keys), np.uint32)
            for often, times in again:
                more[np.searchsorted(keys, often)] += times
            rest = (keys << np.uint64(bits)) >> np.uint64(32)  # the 32 bits behind the part; more documents mean more parts
            return _blobs(keys >> np.uint64(64 - bits), {"keys": rest.astype(np.uint32), "counts": counts.astype(np.uint32), "more": more})

        for batch in batches:
            for part in W.slices(batch["text"]):
                first, _, key = _runs(part, length, gram)
                held.append(W.distinct(key, np.searchsorted(first, part.offsets))[0])
                if len(held[-1]) < len(key):  # keys that a document has more than once
                    (keys, runs), texts = np.unique(key, return_counts=True), np.unique(held[-1], return_counts=True)[1]
                    again.append((keys[runs > texts], (runs - texts)[runs > texts].astype(np.uint32)))
                size += len(part.data)
                if size > KEYS_BYTES:
                    yield hand_over()
                    held, again, size = [], [], 0
        if held:
            yield hand_over()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(part: int, held: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
            keys, counts, more = (np.concatenate([np.frombuffer(x[i], np.uint32) for x in held]) for i in range(3))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)])
            rows, more = (np.add.reduceat(c[order].astype(np.int64), start) if len(start) else c.astype(np.int64) for c in (counts, more))
            maps = []
            for size, often in ((KEY_BITS, rows > 1), (HOT_BITS, (rows >= HOT_DOCS) | ((rows > 1) & (rows + more >= HOT_SEGMENTS)))):
                marks = np.zeros(1 << (size - bits), bool)
                marks[keys[start[often]] >> np.uint32(32 - size + bits)] = True
                maps.append(pa.array([np.packbits(marks).tobytes()], pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *maps], ["part", "marks", "hot"])

        held, last = [], None
        for batch in batches:
            for part, *blobs in zip(*(batch[c].to_pylist() for c in ("part", "keys", "counts", "more")), strict=True):
                if held and part != last:
                    yield answer(last, held)
                    held = []
                held.append(tuple(blobs))
                last = part
        if held:
            yield answer(last, held)

    dealt = shown.select("text").mapInArrow(gather, "part int, keys binary, counts binary, more binary").repartition("part").sortWithinPartitions("part")
    rows = dealt.mapInArrow(merge, "part int, marks binary, hot binary").toArrow()
    repeated, hot = (np.zeros((1 << bits, 1 << (size - bits - 3)), np.uint8) for size in (KEY_BITS, HOT_BITS))
    for part, marks, often in zip(*(rows[c].to_pylist() for c in ("part", "marks", "hot")), strict=True):
        repeated[part], hot[part] = np.frombuffer(marks, np.uint8), np.frombuffer(often, np.uint8)
    return repeated.ravel(), hot.ravel()


def _marked(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = (keys >> np.uint64(64 - (len(bitmap).bit_length() + 2))).astype(np.int64)
    return (bitmap[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each length, one behind the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def _smallest_owner(text: np.ndarray, at: np.ndarray, size: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For each place of distinct segments: the smallest owner of any segment that holds the string that starts there."""
    array = suffix_array(text)
    shared = common_prefixes(text, array, length)[array] >= length
    group = np.cumsum(~shared)
    whole = np.zeros(len(text), bool)
    whole[_spread(at, size - length + 1)] = True
    held = whole[array]
    place, group = array[held], group[held]
    segment = np.repeat(np.arange(len(at), dtype=np.int32), size)[place]
    least = np.full(group.max() + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, group, owner[segment])
    out = np.full(len(text), np.iinfo(np.int64).max)
    out[place] = least[group]
    return out


def _by_segment(data: np.ndarray, at: np.ndarray, sizes: np.ndarray, value) -> np.ndarray:
    """value(bytes, starts, sizes) of all segments, so many at a time that the temporaries stay small."""
    out, a = [np.zeros(0, np.uint64)], 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(at, at[a] + (1 << 20))))
        out.append(value(data[at[a] : at[b - 1] + sizes[b - 1]], at[a:b] - at[a], sizes[a:b]))
        a = b
    return np.concatenate(out)


def _shard(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, from, to): what the segments of a shard have covered by smaller ids."""
    at = np.cumsum(sizes) - sizes
    hashes = _by_segment(data, at, sizes, lambda d, a, n: W.hash_spans(d, a, a + n))
    _, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
    owner = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(owner, kind, ids)
    least, begin = _least_owners(data, at[first], sizes[first], owner, length, gram)
    count = sizes - length + 1
    covered = least[_spread(begin[kind], count)] < np.repeat(ids, count)
    row, a, b = _true_runs(covered, np.repeat(np.arange(len(ids)), count))
    place = _spread(starts, count)
    return ids[row], place[a], place[b] + length


def _true_runs(covered: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true values within one row: the row, where the run starts and where its last value is."""
    joined = np.zeros(len(covered) + 1, bool)
    joined[1:-1] = covered[1:] & covered[:-1] & (row[1:] == row[:-1])
    a, b = np.flatnonzero(covered & ~joined[:-1]), np.flatnonzero(covered & ~joined[1:])
    return row[a], a, b


def _least_owners(data: np.ndarray, at: np.ndarray, size: np.ndarray, owner: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest owner of the string at each place of different segments, one behind the other, and where each segment's begin."""
    width = length - gram + 1
    grams = lambda d, a, n: _gram_keys(d, gram)[_spread(a, np.full(len(a), width))].reshape(-1, width).min(axis=1)
    text = data[_spread(at, size)]
    key = _by_segment(text, np.cumsum(size) - size, size, grams)
    order = np.argsort(key, kind="stable")
    fresh = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    alone = fresh & np.append(fresh[1:], True)  # the only segment with its key: its strings are in no other
    begin = np.cumsum(size) - size
    text = text[_spread(begin[order], size[order])]
    size = size[order]
    begin = np.cumsum(size) - size
    least = np.repeat(owner[order], size)
    sort, fresh = np.flatnonzero(~alone), fresh[~alone]
    a = 0
    stop = np.cumsum(size[sort])
    while a < len(sort):
        b = int(np.searchsorted(stop, (stop[a - 1] if a else 0) + ARRAY_BYTES, "right"))
        while b > a + 1 and b < len(sort) and not fresh[b]:
            b -= 1
        if b <= a + 1:
            b = a + 1
        while b < len(sort) and not fresh[b]:
            b += 1
        part = sort[a:b]
        place = _spread(begin[part], size[part])
        least[place] = _smallest_owner(text[place], np.cumsum(size[part]) - size[part], size[part], owner[order[part]], length)
        a = b
    back = np.empty(len(order), np.int64)
    back[order] = begin
    return least, back


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, a, b): for each document with covered bytes the byte ranges, as arrays; they may overlap. Ids are BIGINT."""
    spark = docs.sparkSession
    bits = _part_bits(spark)
    shown = docs.where(F.col(id_column).isNotNull() & F.col(text_column).isNotNull()).select(F.col(id_column).alias("id"), W.text_column(text_column).alias("text"))
    repeated, often = _repeated_keys(shown, length, gram, bits)
    bitmap, hot = spark.sparkContext.broadcast(repeated), spark.sparkContext.broadcast(often)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def hand_over() -> pa.RecordBatch:
            key, ids, starts, sizes = (np.concatenate([x[i] for x in held]) for i in range(4))
            data = np.concatenate([x[4] for x in held])
            at = np.cumsum(sizes) - sizes
            order = np.argsort(key >> np.uint64(64 - bits), kind="stable")
            sizes = sizes[order]
            columns = {"ids": ids[order], "starts": starts[order].astype(np.int32), "sizes": sizes.astype(np.int32)}
            return _blobs(key[order] >> np.uint64(64 - bits), columns, (data[_spread(at[order], sizes)], np.append(0, np.cumsum(sizes))))

        for batch in batches:
            ids = batch["id"].to_numpy()
            for part in W.slices(batch["text"]):
                first, last, key = _runs(part, length, gram)
                keep = _marked(bitmap.value, key) & ~_marked(hot.value, key)
                first, last, key = first[keep], last[keep], key[keep]
                doc = np.searchsorted(part.offsets, first, "right") - 1
                sizes = last - first + length
                held.append((key, ids[part.lo + doc], first - part.offsets[doc], sizes, part.data[_spread(first, sizes)]))
                size += len(part.data)
                if size > SEGMENTS_BYTES:
                    yield hand_over()
                    held, size = [], 0
        if held:
            yield hand_over()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(rows: list[dict]) -> pa.RecordBatch:
            join = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rows])
            ids, a, b = _shard(join("ids", np.int64), join("starts", np.int32).astype(np.int64), join("sizes", np.int32).astype(np.int64), join("bytes", np.uint8), length, gram)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["id", "a", "b"])

        rows: list[dict] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i].as_py() for c in batch.schema.names}
                if rows and rows[-1]["part"] != row["part"] and size + len(row["bytes"]) > 2 * ARRAY_BYTES:
                    yield answer(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row["bytes"])
        if rows:
            yield answer(rows)

    segments = shown.mapInArrow(send, "part int, ids binary, starts binary, sizes binary, bytes binary")
    found = segments.repartition("part").sortWithinPartitions("part").mapInArrow(solve, "id long, a int, b int")
    if often.any():
        found = found.unionByName(_hot_spans(shown, bitmap, hot, length, gram, bits))
    return found.groupBy("id").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))


def _hot_spans(shown: DataFrame, bitmap, hot, length: int, gram: int, bits: int) -> DataFrame:
    """(id, a, b) for the segments with hot keys."""

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def hand_over() -> pa.RecordBatch:
            key, ids, starts, sizes = (np.concatenate([x[i] for x in held]) for i in range(4))
            data = np.concatenate([x[4] for x in held])
            at = np.cumsum(sizes) - sizes
            _, first, kind = np.unique(_by_segment(data, at, sizes, lambda d, a, n: W.hash_spans(d, a, a + n)), return_index=True, return_inverse=True)
            order = np.argsort(kind, kind="stable")
            ids, starts = ids[order], starts[order].astype(np.int32)
            begin = np.searchsorted(kind[order], np.arange(len(first)))
            stop = np.append(begin, len(ids))[1:]
            pick = list(zip(begin.tolist(), stop.tolist(), strict=True))
            some = len(first) > 0
            return pa.RecordBatch.from_arrays(
                [
                    pa.array((key[first] >> np.uint64(64 - bits)).astype(np.int32)), pa.array(key[first].view(np.int64)), pa.array([data[a:b].tobytes() for a, b in zip(at[first].tolist(), (at + sizes)[first].tolist(), strict=True)], pa.binary()),
                    pa.array(np.minimum.reduceat(ids, begin) if some else ids), pa.array(np.maximum.reduceat(ids, begin) if some else ids),
                    pa.array([ids[a:b].tobytes() for a, b in pick], pa.binary()), pa.array([starts[a:b].tobytes() for a, b in pick], pa.binary()),
                ],
                ["part", "key", "segment", "lo", "hi", "ids", "starts"],
            )

        for batch in batches:
            own = batch["id"].to_numpy()
            for part in W.slices(batch["text"]):
                first, last, key = _runs(part, length, gram)
                keep = _marked(bitmap.value, key) & _marked(hot.value, key)
                first, last, key = first[keep], last[keep], key[keep]
                doc = np.searchsorted(part.offsets, first, "right") - 1
                sizes = last - first + length
                held.append((key, own[part.lo + doc], first - part.offsets[doc], sizes, part.data[_spread(first, sizes)]))
                size += len(part.data)
                if size > SEGMENTS_BYTES:
                    yield hand_over()
                    held, size = [], 0
        if held:
            yield hand_over()

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ids, starts, least in zip(batch["ids"], batch["starts"], batch["least"], strict=True):
                ids, starts = np.frombuffer(ids.as_py(), np.int64), np.frombuffer(starts.as_py(), np.int32).astype(np.int64)
                least = least.values.to_numpy()
                row, a, b = _true_runs((least[None, :] < ids[:, None]).ravel(), np.repeat(np.arange(len(ids)), len(least)))
                out.append((ids[row], starts[row] + a % len(least), starts[row] + b % len(least) + length))
            columns = [np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), *(pa.array(c.astype(np.int32)) for c in columns[1:])], ["id", "a", "b"])

    members = cut(shown.mapInArrow(collapse, "part int, key long, segment binary, lo long, hi long, ids binary, starts binary"))
    answers = _answers(_collapsed(members, "segment"), length, [gram, *_longer_grams(length, gram)], bits)
    return cut(members.select("segment", "ids", "starts").join(answers, "segment").select("ids", "starts", "least").mapInArrow(cover, "id long, a int, b int"))


def _collapsed(rows: DataFrame, segment: str) -> DataFrame:
    """One row a segment: the smallest and largest id that have it."""
    return rows.groupBy("part", "key", F.col(segment).alias("segment")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _answers(segments: DataFrame, length: int, grams: list[int], bits: int, share: int = 1) -> DataFrame:
    """(segment, least): for different segments (part, key, segment, lo, hi), keyed by the first of ``grams``, the smallest id of each of their strings.

    Segments none of whose strings has a smaller id than ``hi`` may be left out.
    """
    gram = grams[0]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(rows: pa.Table) -> pa.RecordBatch:
            at, data = W.string_buffers(rows["segment"].combine_chunks())
            owner, hi, size = rows["lo"].to_numpy(), rows["hi"].to_numpy(), np.diff(at)
            least, begin = _least_owners(data, at[:-1], size, owner, length, gram)
            count = size - length + 1
            least, ends = least[_spread(begin, count)], np.concatenate(([0], np.cumsum(count)))
            keep = np.flatnonzero(np.minimum.reduceat(least, ends[:-1]) < hi)
            lists = [least[ends[k] : ends[k + 1]] for k in keep.tolist()]
            offsets = np.concatenate(([0], np.cumsum(count[keep]))).astype(np.int32)
            return pa.RecordBatch.from_arrays([rows["segment"].combine_chunks().take(pa.array(keep)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64)))], ["segment", "least"])

        held, size = [], 0
        last = None
        for batch in batches:
            parts = batch["part"].to_numpy()
            bounds, _ = W.string_buffers(batch["segment"])
            edges = np.concatenate(([0], np.flatnonzero(parts[1:] != parts[:-1]) + 1, [len(parts)]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if a == b:
                    continue
                if held and last != parts[a] and size > 2 * ARRAY_BYTES:
                    yield answer(pa.Table.from_batches(held))
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size += int(bounds[b] - bounds[a])
                last = parts[a]
        if held:
            yield answer(pa.Table.from_batches(held))

    solved = lambda rows: rows.repartition("part").sortWithinPartitions("part").mapInArrow(solve, "segment binary, least array<long>")
    if len(grams) == 1:
        return solved(segments)
    segments = cut(segments)
    n = segments.count()
    even = n // (share * int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    crowded = cut(segments.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > min(max(even, CROWD), MOST_CROWD)))
    of_crowded = crowded.agg(F.sum("n")).first()[0]
    if not of_crowded:
        return solved(segments)
    crowded = crowded.select("key")
    dense = segments.join(crowded, "key", "left_semi")
    pieces = cut(_shared_pieces(dense, of_crowded, length, grams[1], bits))
    below = _answers(_collapsed(pieces, "piece"), length, grams[1:], bits, 4).withColumnRenamed("segment", "piece")
    # only pieces that have an answer come back to their segments; the strings between them are in no other segment
    runs = pieces.select("segment", "at", "piece").join(below, "piece").select("segment", F.struct("at", "least").alias("run"), F.lit(None).cast("long").alias("own"))
    owned = dense.where("lo < hi").select("segment", F.lit(None).cast(dict(runs.dtypes)["run"]).alias("run"), F.col("lo").alias("own"))
    sent = runs.unionByName(owned).groupBy("segment").agg(F.array_sort(F.collect_list("run")).alias("runs"), F.coalesce(F.max("own"), F.lit((1 << 63) - 1)).alias("own"))
    alone = lambda n: F.array_repeat("own", n)
    fill = lambda done, run: F.concat(done, alone(run["at"] - F.size(done)), run["least"])
    rest = lambda done: F.concat(done, alone(F.octet_length("segment") - (length - 1) - F.size(done)))
    whole = sent.select("segment", F.aggregate("runs", F.array().cast("array<long>"), fill, rest).alias("least"))
    return solved(segments.join(crowded, "key", "left_anti")).unionByName(whole)


def _shared_pieces(segments: DataFrame, n: int, length: int, gram: int, bits: int) -> DataFrame:
    """(segment, at, part, key, piece, lo, hi): the runs of ``n`` different segments by longer grams, those whose key two segments have."""
    tasks = -(-n // GATHERED)
    repeated, _ = _repeated_keys(segments.select(F.concat("segment", F.lit(b"\n")).alias("text")).coalesce(tasks), length, gram, bits)
    shared = segments.sparkSession.sparkContext.broadcast(repeated)

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, CROWD):
                rows = batch.slice(a, CROWD)
                texts = rows["segment"].to_pylist()
                data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)  # a line feed behind each, as the texts have
                offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
                runs = _runs(W.Slice(0, len(texts), data, offsets), length, gram)
                keep = _marked(shared.value, runs[2])
                first, last, key = (x[keep] for x in runs)
                row = np.searchsorted(offsets, first, "right") - 1
                pieces = [data[a:b].tobytes() for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)]
                own = rows.take(pa.array(row))
                columns = [own["segment"], pa.array((first - offsets[row]).astype(np.int32)), pa.array((key >> np.uint64(64 - bits)).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(pieces, pa.binary()), own["lo"], own["hi"]]
                yield pa.RecordBatch.from_arrays(columns, ["segment", "at", "part", "key", "piece", "lo", "hi"])

    return segments.mapInArrow(finer, "segment binary, at int, part int, key long, piece binary, lo long, hi long")


def dedup_substrings(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, with_bytes: bool = True) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, ``with_bytes``, kept (binary).

    A byte goes if a string of ``length`` bytes that covers it also starts in a document with a
    smaller id; strings are judged on the input. Null text is empty. Rows with null id take
    no part and keep all. Rows that repeat an id count as one document; should their texts differ, each
    loses the ranges of both. Texts shorter than ``length`` keep all. Ids of any type that has an order
    will do; others than whole numbers are ranked first. Other columns are not read; an empty table gives an empty
    one. Long texts are gone through in slices of 1 MB.
    """
    docs, number = numbered(docs.select(id_column, text_column), id_column)
    spans = repeated_spans(docs, number, text_column, length)
    shown = docs.select(F.col(id_column).alias("own"), F.col(number).alias("id"), F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("raw"))
    both = shown.join(spans, "id", "left").select("own", "raw", "a", "b")
    names = [id_column, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_bytes]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, spans = [], [], []
            raws = batch["raw"].to_pylist()
            for raw, a, b in zip(raws, batch["a"], batch["b"], strict=True):
                if not a.is_valid:
                    kept.append(raw)
                    removed.append(0)
                    spans.append(0)
                    continue
                edge = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edge, np.minimum(a.values.to_numpy(), len(raw)), 1)
                np.add.at(edge, np.minimum(b.values.to_numpy(), len(raw)), -1)
                stay = np.cumsum(edge[:-1]) == 0
                kept.append(np.frombuffer(raw, np.uint8)[stay].tobytes())
                removed.append(len(raw) - len(kept[-1]))
                gone = ~stay
                spans.append(int(gone[:1].sum() + (gone[1:] & stay[:-1]).sum()))
            columns = [batch["own"], pa.array([len(r) for r in raws], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(kept, pa.binary())] * with_bytes], names)

    kind = dict(docs.dtypes)[id_column]
    return both.mapInArrow(remove, f"`{id_column}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes)
