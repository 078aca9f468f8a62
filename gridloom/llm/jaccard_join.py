"""Size-aware heavy-light Jaccard self-join of word shingle sets, and its components.

Small sets are joined by enumerating their subsets of a fixed size: for partner size t a
set of size s emits its subsets of the overlap o(s, t) that a link needs, and two sets that
share one are linked. Large sets scan inverted lists: each is listed under its rarest
shingles, as many as a link needs at least one of. The boundary between small and large is
the one with the least cost over the histogram of sizes.

Equal sets are one class and travel once. Lists are not expanded into pairs: their members
are first compared with one hub, linked members are merged, and only members still in
different components are compared again: pivots from outside a list's largest component, sixteen times as many
a round, with all of the list, until every list is one component or all its pairs across components have been
compared. A round deals pivots and members in small groups, so no list is one task's. Three bounds
that lose no link come before a pair is formed: sizes, the shared shingle's places in the
common order, and 256 parity bits whose differences cannot outnumber the sets' own. Of a
pair that is left, the sets' counts in 256 buckets are compared, which bounds their difference
too; only pairs that pass have their sets fetched.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .components import components
from .sketch import bitmap_of, in_bitmap
from ..store import cut, drop_cut

SHINGLE, PERCENT = 4, 85
#: Slots of the table of frequent shingles: 4 MB whatever the data.
FREQUENT_BITS = 20
#: Shingles after which a task hands over what it has found frequent.
COUNTED_AT_ONCE = 1 << 22
#: Inverted-list work of a listed shingle against one enumerated subset: finding, comparing.
SCAN_COST = 4
#: Largest boundary tried.
MOST_SMALL = 24
#: Pivots of a list in the first round, and the factor by which their number grows.
PIVOTS, GROWTH = 256, 16
#: Pivots and members that meet in one group at most, about.
PIVOT_GROUP, MEMBER_GROUP = 256, 4096
#: Ids that are broadcast at most to choose texts: 8 bytes each.
BROADCAST_IDS = 100_000
#: Parity bits of a set, as 64-bit columns.
PARITY = ("p0", "p1", "p2", "p3")
#: Buckets of a set's counts, one byte each.
BUCKETS = 256


def needed(s: int, t: int, percent: int = PERCENT) -> int:
    """Least intersection of two sets of these sizes with 100 * intersection >= percent * union."""
    return -(-percent * (s + t) // (100 + percent))


def partners(s: int, percent: int = PERCENT) -> range:
    """Sizes that a set linked with one of size ``s`` can have."""
    return range(-(-percent * s // 100), 100 * s // percent + 1)


def subsets_of(s: int, percent: int = PERCENT) -> int:
    return sum(math.comb(s, needed(s, t, percent)) for t in partners(s, percent) if needed(s, t, percent) <= min(s, t))


def prefix_of(n, percent: int = PERCENT):
    """How many of its rarest shingles a set of size ``n`` is listed under."""
    return n - (percent * n + 99) // 100 + 1


def boundary(sizes: dict[int, int], percent: int = PERCENT) -> int:
    """Largest size whose sets are enumerated, by least cost over the sizes' histogram."""
    cost = lambda x: sum(n * (subsets_of(s, percent) if s <= x else SCAN_COST * prefix_of(s, percent)) for s, n in sizes.items() if s <= MOST_SMALL)
    return min(range(MOST_SMALL + 1), key=cost)


def _sets(part: W.Slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    return W.distinct(*W.shingles(W.words(part, W.SOLID), k))


def _statistics(shown: DataFrame, k: int, percent: int) -> tuple[np.ndarray, int]:
    """The table of frequent shingles by slot and the boundary, from all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, amount = [], 0, 0
        sizes = np.zeros(MOST_SMALL + 1, np.int64)

        def frequent() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= 4 + docs // 1000
            place = (found[often] >> np.uint64(64 - FREQUENT_BITS)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(place), pa.array(n[often])], ["key", "n"])

        for batch in batches:
            for part in W.slices(batch["text"]):
                values, bounds = _sets(part, k)
                count = np.diff(bounds)
                sizes += np.bincount(count[count <= MOST_SMALL], minlength=len(sizes))
                held.append(values)
                docs += part.n
                amount += len(values)
                if amount > COUNTED_AT_ONCE:
                    yield frequent()
                    held, docs, amount = [], 0, 0
        if held:
            yield frequent()
        yield pa.RecordBatch.from_arrays([pa.array(-np.arange(1, len(sizes) + 1)), pa.array(sizes)], ["key", "n"])

    rows = shown.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = rows["key"].to_numpy(), rows["n"].to_numpy()
    table = np.zeros(1 << FREQUENT_BITS, np.uint32)
    table[key[key >= 0]] = np.minimum(n[key >= 0], (1 << 32) - 1)
    small = {int(-k - 1): int(c) for k, c in zip(key[key < 0], n[key < 0], strict=True) if k < -1 and c}
    return table, boundary(small, percent)


def _subset_tokens(values: np.ndarray, percent: int) -> list[int]:
    """A hash of each subset that a link of this set can need, sizes of both sets included; the order of elements is not."""
    s, out = len(values), [np.zeros(0, np.uint64)]
    mixed = W.mix(values + np.uint64(1))
    total = np.add.reduce(mixed)
    for t in partners(s, percent):
        o = needed(s, t, percent)
        if o > min(s, t):
            continue
        left_out = np.array(list(itertools.combinations(range(s), s - o)), np.int64).reshape(math.comb(s, o), s - o)
        sizes = W.mix(np.array([(min(s, t) << 20 | max(s, t)) << 8 | 1], np.uint64))
        out.append(W.mix((np.full(len(left_out), total) - np.add.reduce(mixed[left_out], axis=1)) ^ sizes))
    return np.concatenate(out).view(np.int64).tolist()


def shingle_classes(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, n, key, parity, tokens, subsets) of (id, text): each set's size, digest, parity bits, bucket counts, rarest shingles and subsets."""
    table, small = _statistics(docs, k, percent)
    sc = docs.sparkSession.sparkContext
    rarity = sc.broadcast(table)
    listed_from = partners(small + 1, percent).start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch["text"]):
                values, bounds = _sets(part, k)
                counts = np.diff(bounds)
                doc = np.repeat(np.arange(part.n, dtype=np.int64), counts)
                seen = rarity.value[values >> np.uint64(64 - FREQUENT_BITS)].astype(np.int64)
                order = np.argsort(doc << 32 | seen, kind="stable")
                place = np.arange(len(values)) - np.repeat(bounds[:-1], counts)
                length = np.where(counts >= listed_from, prefix_of(counts, percent), 0)
                chosen = values[order][place < np.repeat(length, counts)].view(np.int64)
                bounds_chosen = np.concatenate(([0], np.cumsum(np.minimum(length, counts))))
                keys = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() for a, b in itertools.pairwise(bounds.tolist())]
                tokens = pa.ListArray.from_arrays(pa.array(bounds_chosen.astype(np.int32)), pa.array(chosen))
                little = (counts > 0) & (counts <= small)
                subsets = pa.array([_subset_tokens(values[a:b], percent) if x else [] for x, (a, b) in zip(little.tolist(), itertools.pairwise(bounds.tolist()), strict=True)], pa.list_(pa.int64()))
                odd = np.bincount(doc * 256 + (values & np.uint64(255)).astype(np.int64), minlength=part.n * 256) & 1
                parity = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(part.n, 4)
                buckets = np.bincount(doc * BUCKETS + (values >> np.uint64(8) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=part.n * BUCKETS)
                buckets = np.minimum(buckets, 255).astype(np.uint8)
                buckets = pa.Array.from_buffers(pa.binary(), part.n, [None, pa.py_buffer(np.arange(part.n + 1, dtype=np.int32) * BUCKETS), pa.py_buffer(buckets)])
                columns = [pa.array(counts), pa.array(keys, pa.binary()), *(pa.array(np.ascontiguousarray(parity[:, i])) for i in range(4)), buckets, tokens, subsets]
                yield pa.RecordBatch.from_arrays([batch["id"][part.lo : part.hi], *columns], ["id", "n", "key", *PARITY, "buckets", "tokens", "subsets"])

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, n long, key binary, {', '.join(f'{c} long' for c in PARITY)}, buckets binary, tokens array<long>, subsets array<long>")


def _sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, s): the sorted sets of the documents with these ids.

    Up to BROADCAST_IDS ids are broadcast and choose the texts; beyond, a bitmap of fixed size keeps
    most other texts from being cut into words and a join drops the rest.
    """
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    wanted = docs.where("id is not null").select("id", "text", F.xxhash64("id").alias("h"))
    if few:
        wanted = wanted.join(F.broadcast(ids), "id", "left_semi")
    bitmap = None if few else docs.sparkSession.sparkContext.broadcast(bitmap_of(ids.select(F.xxhash64("id").alias("h")), "h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if bitmap is not None:
                batch = batch.filter(pa.array(in_bitmap(bitmap.value, batch["h"].to_numpy().view(np.uint64))))
            for part in W.slices(batch["text"]):
                values, bounds = _sets(part, k)
                yield pa.RecordBatch.from_arrays([batch["id"][part.lo : part.hi], pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))], ["id", "s"])

    found = wanted.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, s array<long>")
    return found if few else found.join(ids, "id", "left_semi")


@F.arrow_udf(T.LongType())
def _apart(x: pa.Array, y: pa.Array) -> pa.Array:
    """By how much two sets differ at least: the sum of their buckets' differences."""
    left, right = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int16) for c in (x, y))
    return pa.array(np.abs(left - right).sum(axis=1).astype(np.int64))


def _linked(pairs: DataFrame, listed: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Those pairs (a, b) whose sets are near enough, compared exactly; None if there are none."""
    left, right = (listed.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("buckets").alias(f"k{c}")) for c in "ab")
    total = F.col("na") + F.col("nb")
    close = pairs.join(left, "a").join(right, "b").withColumn("apart", _apart("ka", "kb"))
    pairs = cut(close.where(F.col("apart") <= total - 2 * F.ceil(percent * total / (100 + percent))).select("a", "b"))
    if pairs.isEmpty():
        return None
    sets = cut(_sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), k))
    left, right = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    links = cut(pairs.join(right, "b").join(left, "a").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b"))
    drop_cut(sets)
    return None if links.isEmpty() else links


def _merge(labels: DataFrame, links: DataFrame | None) -> DataFrame:
    if links is None:
        return labels
    return cut(components(links.unionByName(labels.select(F.col("id").alias("a"), F.col("label").alias("b")))))


def _possible(percent: int):
    """Condition on two members (the second's columns begin with ``o_``) without which they cannot be linked."""
    least = F.ceil(percent * (F.col("n") + F.col("o_n")) / (100 + percent))
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"o_{c}"))) for c in PARITY[1:]), F.bit_count(F.col(PARITY[0]).bitwiseXOR(F.col(f"o_{PARITY[0]}"))))
    return (
        (100 * F.col("n") >= percent * F.col("o_n"))
        & (100 * F.col("o_n") >= percent * F.col("n"))
        & (F.least(F.col("n") - F.col("pos"), F.col("o_n") - F.col("o_pos")) >= least)
        & (apart <= F.col("n") + F.col("o_n") - 2 * least)
    )


def _other(members: DataFrame, *more: str) -> DataFrame:
    return members.select("token", *[F.col(c).alias(f"o_{c}") for c in ("id", "n", "pos", *PARITY, *more)])


def link_components(listed: DataFrame, docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, label) for every class representative that has a link; ``listed``: (id, n, parity, tokens, subsets), one row a class."""
    members = ("token", "id", "n", "pos", *PARITY)
    spots = F.transform(F.concat("tokens", "subsets"), lambda x, i: F.struct(x.alias("token"), F.when(i < F.size("tokens"), i).otherwise(0).alias("pos")))
    postings = listed.select("id", F.inline(spots))
    several = postings.groupBy("token").agg(F.count("*").alias("c"), F.min("id").alias("hub")).where("c > 1").select("token", "hub")
    lists = cut(cut(postings.join(several, "token")).join(listed.select("id", "n", *PARITY), "id"))
    hubs = _other(lists.where(F.col("id") == F.col("hub")))
    pairs = lists.join(hubs, "token").where((F.col("id") != F.col("o_id")) & _possible(percent)).select(F.col("o_id").alias("a"), F.col("id").alias("b")).distinct()
    none = docs.sparkSession.createDataFrame([], f"id {dict(docs.dtypes)['id']}, label {dict(docs.dtypes)['id']}")
    labels = _merge(none, _linked(pairs, listed, docs, k, percent))
    lists, most = lists.select(*members), PIVOTS
    deal = lambda salt, groups: F.pmod(F.xxhash64(F.lit(salt), "id"), groups)
    every = lambda groups: F.explode(F.sequence(F.lit(0), groups - 1))
    while True:
        marked = lists.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        shares = marked.groupBy("token", "label").agg(F.count("*").alias("share"))
        total = shares.groupBy("token").agg(F.sum("share").alias("total"), F.max(F.struct("share", "label")).alias("top")).where("total > top.share")
        # one row an open list; written, so that Spark knows its size and broadcasts it only where it is small
        size = cut(total.select("token", F.col("top.label").alias("largest"), "total", (F.col("total") - F.col("top.share")).alias("outside")))
        if size.isEmpty():
            return labels
        # which of those outside a list's largest component are pivots: all, or about ``most`` by a hash of their ids
        pivot = (F.col("label") != F.col("largest")) & ((F.col("outside") <= most) | (deal(most, F.lit(1 << 30)) < (most / F.col("outside") * (1 << 30))))
        groups = F.ceil(F.least("outside", F.lit(2 * most)) / PIVOT_GROUP), F.ceil(F.col("total") / MEMBER_GROUP)
        still = cut(marked.join(size, "token").select(*members, "label", pivot.alias("pivot"), groups[0].alias("p_groups"), groups[1].alias("m_groups")))
        pivots = still.where("pivot").withColumns({"p": deal("p", F.col("p_groups")), "m": every(F.col("m_groups"))})
        others = still.withColumns({"m": deal("m", F.col("m_groups")), "p": every(F.col("p_groups"))})
        pairs = (
            others.join(pivots.select("token", "p", "m", *[F.col(c).alias(f"o_{c}") for c in (*members[1:], "label")]), ["token", "p", "m"])
            .where((F.col("label") != F.col("o_label")) & (~F.col("pivot") | (F.col("id") > F.col("o_id"))) & _possible(percent))
            .select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b"))
            .distinct()
        )
        labels = _merge(labels, _linked(pairs, listed, docs, k, percent))
        lists, most = still.where("not pivot").select(*members), most * GROWTH


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles (size of its set) and component_id.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. component_id is the smallest id
    reachable by links, its own included. Null, empty and wordless texts have an empty set
    and no link. Rows that share an id count as linked to each other; a row with null id
    gets the component of its set's class, null if all its ids are null. Shingles are compared by 64-bit
    hashes. Other columns are not read; an empty table gives an empty one.
    """
    shown = docs.select(F.col(id_column).alias("id"), W.text_column(text_column).alias("text"))
    rows = cut(shingle_classes(shown, k, percent))
    classes = cut(rows.where("n > 0").groupBy("key").agg(F.min("id").alias("rep"), *[F.first(c).alias(c) for c in ("n", *PARITY, "buckets", "tokens", "subsets")]))
    listed = classes.where("rep is not null").select(F.col("rep").alias("id"), "n", *PARITY, "buckets", "tokens", "subsets")
    labels = link_components(listed, shown, k, percent)
    several = cut(rows.where("n > 0 and id is not null").groupBy("id").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x != y").select("id"))
    if not several.isEmpty():  # ids whose rows are in several classes link these
        labels = _merge(labels, rows.where("n > 0").join(several, "id").join(classes.select("key", "rep"), "key").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    named = classes.select("key", "rep").join(labels, F.col("rep") == F.col("id"), "left").select("key", F.coalesce("label", "rep").alias("component"))
    return rows.select("id", "n", "key").join(named, "key", "left").select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
