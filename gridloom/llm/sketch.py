"""Fixed-size summaries that tasks fill, Spark adds up and every task may hold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A bitmap of 2**26 bits: 8 MB whatever the data. A full one lets everything through, never loses anything.
BITS = 26


def slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def bitmap_of(keys: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """The bitmap of the top bits of a BIGINT column's hashes: words of 64 bits, joined by ``bit_or``.

    At most ``2**bits / 64`` rows reach the driver, however many keys there are.
    """
    place = F.shiftrightunsigned(F.col(column), 64 - bits)
    rows = (
        keys.select(F.shiftright(place, 6).alias("word"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << max(bits - 6, 0), np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


#: Bits of a bitmap that goes with its keys: sixteen a key within these bounds (128 KB to 128 MB).
FEWEST_BITS, MOST_BITS = 20, 30


def sized_bitmap(keys: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """A bitmap of hashes with some sixteen bits a key, and the log of its size."""
    bits = min(MOST_BITS, max(FEWEST_BITS, (16 * keys.count()).bit_length()))
    return bitmap_of(keys, column, bits), bits


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray, bits: int = BITS) -> np.ndarray:
    place = slot(keys, bits)
    return (bitmap[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1


def counters(df: DataFrame, key: str, value: str, size: int, dtype=np.int64) -> np.ndarray:
    """Sum of ``value`` by ``key`` (0 to ``size`` - 1): at most ``size`` rows reach the driver."""
    rows = df.groupBy(key).agg(F.sum(value).alias("total")).toArrow()
    out = np.zeros(size, dtype)
    out[rows[key].to_numpy()] = rows["total"].to_numpy()
    return out


def count_batch(keys: np.ndarray) -> pa.RecordBatch:
    """The keys of one task with their counts, for a sum over all tasks."""
    found, counts = np.unique(keys, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(counts.astype(np.int64))], ["key", "n"])
