"""The daily aggregation over a stream of site records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_daily(records: DataFrame, features: list[str], by: tuple[str, ...] = ("gid",), lateness: str = "1 day", window: str = "1 day") -> DataFrame:
    """Mean of the features by site and day; records later than ``lateness`` are left out, finished days are emitted once (append mode)."""
    means = records.withWatermark("time", lateness).groupBy(*by, F.window("time", window).alias("w")).agg(*[F.avg(f).alias(f) for f in features])
    return means.select(*by, F.col("w.start").alias("day"), *features)
