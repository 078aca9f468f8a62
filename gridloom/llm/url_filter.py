"""URL filters by a sorted digest array.

Every rule string (``host/path``) has a 64-bit xxhash key; so has every host that has rules, with the
lengths of its rules' paths. Spark sorts the keys in ranges, and each task writes its
range as one shard: sorted keys, full strings, lengths. The driver keeps the shards' least keys alone; a task
memory-maps the shards that its keys fall into. A url's hosts (each suffix at a label border) are probed
first, by one vectorised binary search a batch, then the path prefixes whose lengths its hosts
name; a found key counts only if the stored full string equals the candidate, so collisions decide nothing.
"""

from __future__ import annotations

import os
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import new_folder

#: The rules of the contract, (verdict, host/path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: First labels of hosts that publish spam, gambling, pills or trackers. An example of a list; production
#: lists come as a table of rules.
SPAM_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
SPAM_DOMAINS = ("example.com", "example.net", "example.org")
BLOCKLIST = tuple(f"{name}.{domain}/" for name in SPAM_NAMES for domain in SPAM_DOMAINS)

#: Rules and hosts to a shard, about: some 60 MB.
SHARD_ROWS = 1_000_000
#: Seed of Spark's own xxhash64.
SEED = 42

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; path: then up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def key_of(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, SEED)


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


class Shard:
    """Sorted keys with their strings and lists of lengths, over one buffer: counts, keys, ends of strings, ends of lists, lengths, strings."""

    def __init__(self, data: np.ndarray):
        n, m, _ = (int(x) for x in data[:24].view(np.int64))
        cuts = np.cumsum([24, 8 * n, 8 * n, 8 * n, 8 * m])
        self.keys = data[cuts[0] : cuts[1]].view(np.uint64)
        self.ends, self.stops, self.lengths = (data[a:b].view(np.int64) for a, b in zip(cuts[1:], cuts[2:], strict=False))
        self.text = data[cuts[4] :]

    @staticmethod
    def pack(rows: list[tuple[int, bytes, list[int]]]) -> bytes:
        """``rows`` (key, string, lengths) in order of key."""
        lengths = [n for _, _, ns in rows for n in ns]
        counts = np.array([len(rows), len(lengths), 0], np.int64)
        keys = np.array([k for k, _, _ in rows], np.uint64)
        ends, stops = (np.cumsum([len(r[k]) for r in rows], dtype=np.int64) for k in (1, 2))
        return b"".join([counts.tobytes(), keys.tobytes(), ends.tobytes(), stops.tobytes(), np.array(lengths, np.int64).tobytes(), *(t for _, t, _ in rows)])

    def find(self, keys: np.ndarray, texts: list[bytes]) -> list[int]:
        """Where each text is stored, -1 for nowhere: one binary search for all keys, then the full strings of equal keys."""
        at = np.searchsorted(self.keys, keys)
        out = [-1] * len(texts)
        inside = np.flatnonzero(at < len(self.keys))
        for i in inside[self.keys[at[inside]] == keys[inside]].tolist():
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == keys[i] and out[i] < 0:
                if self.text[self.ends[j - 1] if j else 0 : self.ends[j]].tobytes() == texts[i]:
                    out[i] = j
                j += 1
        return out

    def lengths_of(self, j: int) -> list[int]:
        return self.lengths[self.stops[j - 1] if j else 0 : self.stops[j]].tolist()


def write_shard(folder: str, name: str, content: bytes) -> None:
    """One file in the shared folder, under its name only when it is whole; a repeated task writes it again."""
    store, inner = _place(f"{folder}/{name}")
    store.create_dir(os.path.dirname(inner), recursive=True)
    own = f"{inner}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(content)
    store.move(own, inner)


class DigestArray:
    """Shards of a list of rules in the shared folder: the folder, and the least key of each shard in order."""

    def __init__(self, folder: str, least: np.ndarray):
        self.folder, self.least = folder, least

    @classmethod
    def of_list(cls, spark: SparkSession, rules: Iterable[str]) -> DigestArray:
        """A short list that the driver has anyway, as one shard."""
        lengths: dict[str, set[int]] = defaultdict(set)
        for r in rules:
            lengths[r.partition("/")[0]].add(len(r) - r.find("/") if "/" in r else 0)
        texts = [(r.encode(), []) for r in set(rules)] + [(h.encode() + b"\0", sorted(n)) for h, n in lengths.items()]
        rows = sorted((key_of(t), t, n) for t, n in texts)
        folder = new_folder(spark, "digests")
        write_shard(folder, "0", Shard.pack(rows))
        return cls(folder, np.array([0], np.uint64))

    @classmethod
    def of_table(cls, entries: DataFrame, shard_rows: int = SHARD_ROWS) -> DigestArray:
        """Any number of rules (column ``rule``, nulls do not count): tasks sort and write the shards, the driver gets one row a shard."""
        folder = new_folder(entries.sparkSession, "digests")
        rules = entries.where("rule is not null").select("rule").distinct()
        at = F.instr("rule", "/")
        host = F.when(at > 0, F.substring_index("rule", "/", 1)).otherwise(F.col("rule"))
        length = F.when(at > 0, F.length("rule") - at + 1).otherwise(0).cast("long")
        hosts = rules.groupBy(F.concat(host, F.lit("\0")).alias("text")).agg(F.array_sort(F.collect_set(length)).alias("lengths"))
        both = rules.select(F.col("rule").alias("text"), F.array().cast("array<long>").alias("lengths")).unionByName(hosts)
        order = [F.col("key") < 0, F.col("key"), F.col("text")]  # as unsigned numbers
        count = max(1, -(-both.count() // shard_rows))
        dealt = both.withColumn("key", F.xxhash64("text")).repartitionByRange(count, *order[:2]).sortWithinPartitions(*order)

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows: list[tuple[int, bytes, list[int]]] = []
            for batch in batches:
                keys = batch["key"].to_numpy().view(np.uint64).tolist()
                rows += [(k, t.encode(), n) for k, t, n in zip(keys, batch["text"].to_pylist(), batch["lengths"].to_pylist(), strict=True)]
            if rows:
                shard = TaskContext.get().partitionId()
                write_shard(folder, str(shard), Shard.pack(rows))
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array(np.array([rows[0][0]], np.uint64).view(np.int64))], ["shard", "least"])

        found = sorted((r["least"] % (1 << 64), r["shard"]) for r in dealt.mapInArrow(write, "shard long, least long").collect())
        if [s for _, s in found] != list(range(len(found))):
            found = cls._renumbered(folder, found)
        return cls(folder, np.array([k for k, _ in found], np.uint64))

    @staticmethod
    def _renumbered(folder: str, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Shards under their place in order; ranges without rows wrote none."""
        for place, (_, shard) in enumerate(found):
            if place != shard:
                (store, old), (_, new) = _place(f"{folder}/{shard}"), _place(f"{folder}/{place}")
                store.move(old, new)
        return found


class Probe:
    """The shards that a task has needed so far, mapped where the folder is mounted, read elsewhere."""

    def __init__(self, array: DigestArray):
        self.folder, self.least, self.shards = array.folder, array.least, {}

    def _shard(self, k: int) -> Shard:
        if k not in self.shards:
            store, inner = _place(f"{self.folder}/{k}")
            if isinstance(store, fs.LocalFileSystem):
                data = np.memmap(inner, np.uint8, "r")
            else:
                with store.open_input_file(inner) as f:
                    data = np.frombuffer(f.read(), np.uint8)
            self.shards[k] = Shard(data)
        return self.shards[k]

    def found(self, keys: np.ndarray, texts: list[bytes]) -> list[tuple[int, int]]:
        """(shard, place) of each text, place -1 for one that is not stored."""
        out = [(-1, -1)] * len(texts)
        if not len(self.least):
            return out
        of = np.maximum(np.searchsorted(self.least, keys, "right") - 1, 0)
        for k in np.unique(of).tolist():
            mine = np.flatnonzero(of == k)
            for i, j in zip(mine.tolist(), self._shard(k).find(keys[mine], [texts[i] for i in mine.tolist()]), strict=True):
                out[i] = (k, j)
        return out

    def fits(self, hosts: list[list[str]], paths: list[str]) -> list[list[str]]:
        """Of each url all stored rules that fit: hosts are looked up first, then the paths of the lengths that they have."""
        tails = list({h for hs in hosts for h in hs})
        raw = [h.encode() + b"\0" for h in tails]
        lengths = {h: self._shard(k).lengths_of(j) for h, (k, j) in zip(tails, self.found(np.array([key_of(t) for t in raw], np.uint64), raw), strict=True) if j >= 0}
        wanted = [[h + p[:n] for h in hs if h in lengths for n in lengths[h] if n <= len(p)] for hs, p in zip(hosts, paths, strict=True)]
        flat = list({c for cs in wanted for c in cs})
        raw = [c.encode() for c in flat]
        held = {c for c, (_, j) in zip(flat, self.found(np.array([key_of(t) for t in raw], np.uint64), raw), strict=True) if j >= 0}
        return [[c for c in cs if c in held] for cs in wanted]


def filter_urls(pages: DataFrame, rules=RULES, blocklist: DataFrame | Iterable[str] = BLOCKLIST, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule (the longest fitting one, else null) and verdict.

    A rule fits its host and all subdomains if the path starts with the rule's path; of
    two fitting rules of one length the one with the longer host wins. Without a rule the verdict is block if an entry of
    ``blocklist`` (a short list, or a table of any size with the column ``rule``) fits, else allow. Both lists are looked up in one digest
    array; a rule without ``/`` fits any path. A null url, or one without ``://``, has empty host and path and no rule: allow. Rows are judged
    one by one, so repeated rows and ids, null ids, other columns and empty tables need no care.
    """
    verdicts = {rule: verdict for verdict, rule in rules}
    spark = pages.sparkSession
    if isinstance(blocklist, DataFrame):
        own = spark.createDataFrame([(r,) for r in verdicts], "rule string")
        array = DigestArray.of_table(blocklist.select("rule").unionByName(own))
    else:
        array = DigestArray.of_list(spark, [*blocklist, *verdicts])
    host, path = host_and_path(F.col(url_column))
    parsed = pages.select(F.col(id_column), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = Probe(array)
        for batch in batches:
            labels = [h.split(".") for h in batch["host"].to_pylist()]
            hosts = [[".".join(ls[i:]) for i in range(len(ls))] for ls in labels]
            ruled, verdict = [], []
            for fits in probe.fits(hosts, batch["path"].to_pylist()):
                best = max((c for c in fits if c in verdicts), key=lambda c: (len(c), c.find("/")), default=None)
                ruled.append(best)
                verdict.append(verdicts[best] if best is not None else "block" if fits else "allow")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch["host"], batch["path"], pa.array(ruled, pa.string()), pa.array(verdict, pa.string())], [id_column, "host", "path", "rule", "verdict"])

    kind = dict(pages.dtypes)[id_column]
    return parsed.mapInArrow(judge, f"`{id_column}` {kind}, host string, path string, rule string, verdict string")
