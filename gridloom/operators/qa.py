"""Checks of generated data against their source, spectra and distributions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stats
from .coarsen import spatial, temporal
from .windows import difference


def recoarsen_error(fine: DataFrame, source: DataFrame, features: list[str], s: int, t: int, methods: dict[str, str] | None = None) -> DataFrame:
    """(south_north, west_east, t_block, f_synthetic, f_true, f_error): the fine data coarsened again, less the source.

    Both have t_idx. A cell or time that only one of the two has raises when it is computed.
    """
    out = source.withColumnRenamed("t_idx", "t_block").withColumn("_source", F.lit(True)).select("_source", "south_north", "west_east", "t_block", *[F.col(f).alias(f"{f}_true") for f in features])
    coarse = spatial(fine, features, s, by=("t_idx",))
    place = ("south_north", "west_east", "t_block")
    for f in features:
        again = temporal(coarse, [f], t, (methods or {}).get(f, "average")).withColumnRenamed(f, f"{f}_synthetic").withColumn("_fine", F.lit(True))
        out = out.join(again, list(place), "full")
        error = F.when(F.col("_source") & F.col("_fine"), F.col(f"{f}_synthetic") - F.col(f"{f}_true"))
        apart = F.col("_source").isNull() | F.col("_fine").isNull()
        out = out.withColumn(f"{f}_error", F.when(apart, F.raise_error(F.lit("the coarsened data and the source differ in shape")).cast("double")).otherwise(error)).drop("_fine")
    return out.drop("_source")


def _spectrum(df: DataFrame, features: list[str], by: list[str], others: list[str], along: str, name: str, reach: tuple[float, float] | None, skip_mean: bool) -> DataFrame:
    """(by, name, energy): amplitudes of transforms along one axis, squared and added over the other axes, times squared frequency, both halves added.

    The mean over the other axes of a transform along all of them equals that sum (Parseval), so a task needs one line of cells at a time.
    """
    keys = [*by, *others]
    n = (df.agg(F.max(along)).first()[0] or 0) + 1  # places without a row count as 0
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        energy = np.zeros(n)
        for c in features:
            line = np.zeros(n)
            line[pdf[along]] = pdf[c]
            energy += np.abs(np.fft.fft(line)) ** 2
        return pd.DataFrame({**{b: pdf[b].iloc[0] for b in by}, "_k": np.arange(n), "_n": n, "_e": energy})

    lines = df.groupBy(*keys).applyInPandas(run, ", ".join(f"{b} {kinds[b]}" for b in by) + ", _k int, _n int, _e double")
    total = lines.groupBy(*by, "_k", "_n").agg(F.sum("_e").alias("_e"))
    low, high = reach or (0.0, None)
    step = F.lit(1.0) if reach is None else F.lit(high - low) / F.greatest(F.col("_n") - 1, F.lit(1))
    half, k = F.floor(F.col("_n") / 2), F.col("_k")
    energy = F.pow(low + k * step, 2) * F.col("_e")
    # place of the first half, and of the second half counted from the end
    first = F.when(k - int(skip_mean) < half, k - int(skip_mean))
    second = F.when(k >= F.col("_n") - half, F.col("_n") - 1 - k)
    places = F.filter(F.array(first, second), lambda p: p.isNotNull() & (p >= 0))
    spread = total.select(*by, "_n", energy.alias("_e"), F.explode(places).alias("_at"))
    summed = spread.groupBy(*by, "_n", "_at").agg(F.sum("_e").alias("energy"))
    return summed.select(*by, (low + F.col("_at") * step).cast("double").alias(name), "energy")


def frequency_spectrum(df: DataFrame, features: list[str], by: list[str], f_range: tuple[float, float] | None = None) -> DataFrame:
    """(by, frequency, energy) of series over all cells of a group; two features give kinetic energy."""
    return _spectrum(df, features, by, ["south_north", "west_east"], "t_idx", "frequency", f_range, False)


def wavenumber_spectrum(df: DataFrame, features: list[str], by: list[str], x_range: tuple[float, float] | None = None, axis: int = 0) -> DataFrame:
    """(by, wavenumber, energy) of one field a group, along its columns (axis 0) or its rows (axis 1)."""
    other, along = ("south_north", "west_east") if axis == 0 else ("west_east", "south_north")
    return _spectrum(df, features, by, [other], along, "wavenumber", x_range, True)


def direct_distribution(df: DataFrame, feature: str, least: float, most: float, bins: int = 40, scale: float = 1.0) -> DataFrame:
    return stats.histogram(df.withColumn(feature, F.col(feature) / scale), feature, least, most, bins)


def gradient_distribution(df: DataFrame, feature: str, least: float, most: float, bins: int = 40, period: float | None = None) -> DataFrame:
    """Of the differences from west to east."""
    steps = difference(df, feature, "west_east", ("south_north", "time"), 1, period)
    return stats.histogram(steps, f"{feature}_diff", least, most, bins)


def time_derivative_distribution(df: DataFrame, feature: str, least: float, most: float, bins: int = 40, lag: int = 1, period: float | None = None) -> DataFrame:
    steps = difference(df, feature, "time", ("south_north", "west_east"), lag, period)
    return stats.histogram(steps, f"{feature}_diff", least, most, bins)
