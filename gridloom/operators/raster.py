"""Cropping, slicing and masking of cubes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL = ("south_north", "west_east")


def closest_cell(grid: DataFrame, latitude: float, longitude: float, threshold: float | None = None) -> tuple[int, int]:
    """Row and column of the nearest cell (least row, then column, on a tie); too far raises."""
    distance = F.hypot(F.col("latitude") - latitude, F.col("longitude") - longitude)
    best = grid.select(F.struct(distance.alias("d"), *CELL).alias("s")).agg(F.min("s").alias("s")).first()["s"]
    if best is None:
        raise ValueError("an empty grid has no closest cell")
    if threshold is not None and best["d"] > threshold:
        raise RuntimeError(f"closest cell is {best['d']:.4f} degrees away, more than {threshold}")
    return best["south_north"], best["west_east"]


def crop(df: DataFrame, grid: DataFrame, target: tuple[float, float], shape: tuple[int, int], threshold: float | None = None, reindex: bool = True) -> DataFrame:
    """Rows and columns of a raster whose lower left cell is nearest to ``target``.

    The corner is found first, so the crop is a range predicate of literals that reaches the scan.
    """
    row, column = closest_cell(grid, *target, threshold)
    top = max(row - shape[0] + 1, 0)
    cut = df.where(F.col("south_north").between(top, row) & F.col("west_east").between(column, column + shape[1] - 1))
    return cut.withColumns({"south_north": F.col("south_north") - top, "west_east": F.col("west_east") - column}) if reindex else cut


def index_slice(df: DataFrame, **ranges: tuple[int | None, int | None]) -> DataFrame:
    """Half-open index ranges by column, as slices."""
    for c, (a, b) in ranges.items():
        if a is not None:
            df = df.where(F.col(c) >= a)
        if b is not None:
            df = df.where(F.col(c) < b)
    return df


def time_index(df: DataFrame, time: str = "time") -> DataFrame:
    """``t_idx``: rank of the row's time among the different times. Only the times are ranked."""
    ranks = df.select(time).distinct().withColumn("t_idx", F.row_number().over(Window.orderBy(time)) - 1)
    return df.join(ranks, time)


def time_slice(df: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1, time: str = "time") -> DataFrame:
    indexed = time_index(df, time)
    first = start or 0
    keep = (F.col("t_idx") >= first) & ((F.col("t_idx") - first) % step == 0)
    return indexed.where(keep if stop is None else keep & (F.col("t_idx") < stop)).drop("t_idx")


def drop_null_steps(df: DataFrame, features: list[str], by: str = "time") -> DataFrame:
    """Without the times at which any cell lacks any of the features."""
    missing = F.bool_or(F.greatest(*[F.col(f).isNull() for f in features])) if len(features) > 1 else F.bool_or(F.col(features[0]).isNull())
    return df.join(df.groupBy(by).agg(missing.alias("bad")).where("bad").select(by), by, "left_anti")


def night(df: DataFrame, clearsky: str = "clearsky_ghi", least: float = 1.0) -> DataFrame:
    """``night``: true for all cells of a time at which any cell has no more clear-sky irradiance than ``least``."""
    dark = df.groupBy("time").agg(F.coalesce(F.bool_or(F.col(clearsky) <= least), F.lit(False)).alias("night"))
    return df.join(dark, "time")


def masked_chunks(df: DataFrame, chunk: str = "s_chunk", mask: str = "mask") -> DataFrame:
    """Chunks that are masked throughout."""
    return df.groupBy(chunk).agg(F.bool_and(mask).alias("masked")).where("masked").select(chunk)


def require_features(df: DataFrame, features: list[str]) -> None:
    """Raises if a feature is null anywhere."""
    counts = df.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in features]).first()
    bad = {f: counts[f] for f in features if counts[f]}
    if bad:
        raise ValueError(f"missing values: {bad}")


def failed_output(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, failed): whether an output has nulls or is the same everywhere."""
    one = df.agg(*[F.struct((F.bool_or(F.col(f).isNull()) | (F.min(f) == F.max(f))).alias("failed")).alias(f) for f in features])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}.failed").alias("failed")) for f in features])).alias("r")).select("r.*")


def not_yet_written(chunks: DataFrame, written: DataFrame, by: str = "chunk_id") -> DataFrame:
    return chunks.join(written.select(by).distinct(), by, "left_anti")
