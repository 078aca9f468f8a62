"""Stitching chunk outputs into one data set."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import cut, free_name, ranked


def chunk_of_file(column=None):
    """(t_chunk, s_chunk) from file names that end in ``_{t}_{s}.ext`` with six digits each."""
    name = F.input_file_name() if column is None else column
    part = lambda k: F.regexp_extract(name, r"_(\d{6})_(\d{6})\.[A-Za-z0-9]+(/|$)", k).cast("int")
    return part(1), part(2)


def read_chunks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All chunk files as one frame, missing columns null."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def combine(frames: list[DataFrame], keys: tuple[str, ...] = ("gid", "time"), overlap: bool = True) -> DataFrame:
    """Chunks one below the other. Of rows with the same keys in several chunks that of the first chunk stays; without ``overlap`` nothing is shuffled."""
    order = free_name(frames[0], "part")
    out = frames[0] if not overlap else frames[0].withColumn(order, F.lit(0))
    for k, f in enumerate(frames[1:], 1):
        out = out.unionByName(f.withColumn(order, F.lit(k)) if overlap else f, allowMissingColumns=True)
    if not overlap:
        return out
    values = [c for c in out.columns if c not in keys and c != order]
    first = out.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(order, *values)).alias(order))
    return first.select(*[c if c in keys else F.col(f"{order}.{c}") for c in out.columns if c != order])


def merge_features(frames: list[DataFrame], keys: tuple[str, ...] = ("gid", "time")) -> DataFrame:
    """Features of several files side by side."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, list(keys), "full")
    return out


def place(df: DataFrame, meta: DataFrame, strict: bool = False) -> DataFrame:
    """``df`` with ``row``, its site's place in the output (places run from 0 by gid); sites of a chunk that do not follow each other raise.

    ``meta`` has one row a site; rows of sites that it lacks go with a warning, or raise with ``strict``.
    """
    rows = ranked(cut(meta.select("gid").distinct()), F.asc("gid"), name="row").withColumn("row", F.col("row") - 1)
    rows = cut(rows)
    span = df.select("gid").distinct().join(rows, "gid", "left").agg((F.max("row") - F.min("row") + 1).alias("span"), F.count("*").alias("n"), F.count("row").alias("known")).first()
    unknown = span["n"] - span["known"]
    if unknown and strict:
        raise ValueError(f"{unknown} sites are not in the output's list")
    if unknown:
        warnings.warn(f"{unknown} sites are not in the output's list; their rows are left out", stacklevel=2)
    if span["known"] and span["span"] != span["known"]:
        raise ValueError(f"{span['known']} sites lie on {span['span']} rows of the output")
    return df.join(rows, "gid")


def duplicate_steps(df: DataFrame, keys: tuple[str, ...] = ("gid", "time")) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def only_targets(df: DataFrame, meta: DataFrame, targets: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Rows of the sites that lie on target coordinates."""
    from .neighbors import same_places

    return df.join(same_places(meta, targets, tolerance).select("gid"), "gid", "left_semi")


def to_speed_direction(df: DataFrame, pairs: list[tuple[str, str]], theta: str | None = None) -> DataFrame:
    """u/v columns replaced by wind speed and direction of the same height."""
    from ..functions.names import output_names
    from ..functions.scalars import direction, speed

    for u, v in pairs:
        angle = F.col(theta) if theta else 0.0
        ws, wd = output_names([u, v])
        df = df.withColumns({ws: speed(F.col(u), F.col(v), angle), wd: direction(F.col(u), F.col(v), angle)}).drop(u, v)
    return df
