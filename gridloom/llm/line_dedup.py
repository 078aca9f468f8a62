"""Line dedup over overlapping windows of three lines.

Each run of three consecutive non-blank lines is hashed (128 bits). Windows that occur
more than once in the corpus are found by one partial aggregation; every occurrence but
the first (smallest document id, then place) covers its three lines, and the covered
lines of a document are merged and removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import free_name

#: Lines in a window.
WINDOW = 3


def _window_rows(docs: DataFrame, id_column: str, text_column: str, window: int) -> DataFrame:
    """(id, th, at, hash): each window of each text; ``at`` counts non-blank lines from 0."""
    lines = F.filter(F.split(F.col(text_column), "\n"), lambda x: F.trim(x) != "")
    hashed = docs.where(F.col(text_column).contains("\n")).select(
        F.col(id_column).alias("id"),
        F.xxhash64(text_column).alias("th"),
        F.transform(lines, lambda x: F.unhex(F.md5(x))).alias("hs"),
    )
    joined = lambda i: F.concat(*[F.get(F.col("hs"), i + k) for k in range(window)])
    return hashed.where(F.size("hs") >= window).select(
        "id",
        "th",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.size("hs") - window), lambda i: F.unhex(F.md5(joined(i))))).alias("at", "hash"),
    )


def repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, th, covered): for each text with repeated windows where its later occurrences start."""
    rows = _window_rows(docs, id_column, text_column, window)
    repeated = rows.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "at")).alias("first")).where("n > 1")
    later = rows.join(repeated, "hash").where(~F.struct("id", "th", "at").eqNullSafe(F.col("first")))
    return later.groupBy("id", "th").agg(F.collect_set("at").alias("covered"))


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with all their columns, repeated lines taken out of the text.

    Two columns are added behind them: ``lines_total`` (lines, split at line feeds; 0 for null) and
    ``lines_removed``, with underscores appended where ``docs`` has such a column. Blank lines (nothing but spaces) are in no window and always stay.
    Windows are judged on the input: of equal windows only the first in order of (id, text
    hash, place) is kept, within a document too. Texts of fewer than three non-blank lines
    and null texts stay as they are. Rows with one id and one text count as one document
    and are all returned, treated alike; null ids come first in the order. Other columns are carried
    untouched, whatever their names; an empty table gives an empty one.
    """
    covered = repeated_lines(docs, id_column, text_column, window)
    names = docs.columns
    packed = docs.select(
        F.col(id_column).alias("id"), F.xxhash64(text_column).alias("th"), F.col(text_column).alias("body"), F.struct(*[F.col(f"`{c}`") for c in names if c != text_column]).alias("rest")
    )
    both = packed.alias("d").join(covered.alias("c"), F.expr("d.id <=> c.id and d.th = c.th"), "left").select("d.rest", "d.body", "c.covered")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, gone = [], [], []
            for text, spots in zip(batch["body"], batch["covered"].to_pylist(), strict=True):
                lines = text.as_py().split("\n") if text.is_valid else []
                total.append(len(lines))
                if not spots:
                    kept.append(text.as_py())
                    gone.append(0)
                    continue
                solid = [i for i, line in enumerate(lines) if line.strip(" ")]
                out = {solid[s + k] for s in spots for k in range(window)}
                kept.append("\n".join(line for i, line in enumerate(lines) if i not in out))
                gone.append(len(out))
            yield pa.RecordBatch.from_arrays([batch["rest"], pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], ["rest", "body", "lines_total", "lines_removed"])

    fields = [T.StructField("rest", both.schema["rest"].dataType), T.StructField("body", T.StringType()), T.StructField("lines_total", T.LongType()), T.StructField("lines_removed", T.LongType())]
    done = both.mapInArrow(rewrite, T.StructType(fields))
    added = [F.col(c).alias(free_name(docs, c)) for c in ("lines_total", "lines_removed")]
    return done.select(*[F.col("body").alias(c) if c == text_column else F.col(f"rest.`{c}`") for c in names], *added)
