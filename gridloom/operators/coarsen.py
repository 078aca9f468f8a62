"""Coarsening in space and time: one partial aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .raster import time_index


def _block(column: str, s: int) -> Column:
    return F.floor(F.col(column) / s).cast("int")


def spatial(df: DataFrame, features: list[str], s: int, by: tuple[str, ...] = ("time",), strict: bool = True) -> DataFrame:
    """Mean over s by s blocks. ``strict``: null where any of the block's cells lacks a value, else over those that have one.

    A strict grid whose last block is cut off raises when it is computed; :func:`trim` takes such blocks away.
    """
    value = lambda f: F.when(F.count(f) == s * s, F.sum(f) / (s * s)) if strict else F.avg(f)
    row, column = _block("south_north", s), _block("west_east", s)
    short = (F.max("south_north") % s != s - 1) | (F.max("west_east") % s != s - 1)
    blocks = df.groupBy(row.alias("_row"), column.alias("_column"), *by).agg(*[value(f).alias(f"_{f}") for f in features], short.alias("_short"))
    whole = lambda f: _whole(F.col(f"_{f}"), F.col("_short"), f"the grid cannot be cut into blocks of {s}") if strict else F.col(f"_{f}")
    return blocks.select(F.col("_row").alias("south_north"), F.col("_column").alias("west_east"), *by, *[whole(f).alias(f) for f in features])


def _whole(value: Column, short: Column, message: str) -> Column:
    return F.when(short, F.raise_error(F.lit(message)).cast("double")).otherwise(value)


def check_divisible(rows: int, columns: int, s: int) -> None:
    if rows % s or columns % s:
        raise ValueError(f"a grid of {rows} by {columns} cannot be cut into blocks of {s}")


def trim(df: DataFrame, rows: int, columns: int, s: int) -> DataFrame:
    """Without the rows and columns behind the last whole block."""
    return df.where((F.col("south_north") < s * (rows // s)) & (F.col("west_east") < s * (columns // s)))


#: How a block of times becomes one: subsample takes the first; average divides by the whole length, nulls counting nothing.
TEMPORAL = {
    "subsample": lambda f, t, n: F.min_by(f, t),
    "average": lambda f, t, n: F.coalesce(F.sum(f), F.lit(0.0)) / n,
    "total": lambda f, t, n: F.coalesce(F.sum(f), F.lit(0.0)),
    "max": lambda f, t, n: F.when(F.count(f) == F.count("*"), F.max(f)),
    "min": lambda f, t, n: F.when(F.count(f) == F.count("*"), F.min(f)),
}


def temporal(df: DataFrame, features: list[str], t: int, method: str = "average", by: tuple[str, ...] = ("south_north", "west_east"), rest: str = "raise") -> DataFrame:
    """Blocks of ``t`` successive times to one, by method; keyed by ``t_block``. Needs ``t_idx`` or a time to rank.

    A last block without all its times raises when it is computed, or goes with ``rest="drop"``.
    """
    indexed = df if "t_idx" in df.columns else time_index(df)
    how = TEMPORAL[method]
    blocks = indexed.groupBy(*by, _block("t_idx", t).alias("t_block")).agg(*[how(f, "t_idx", t).alias(f) for f in features], (F.max("t_idx") % t != t - 1).alias("_short"))
    if rest == "drop":
        return blocks.where("not _short").drop("_short")
    return blocks.withColumns({f: _whole(F.col(f), F.col("_short"), f"the times cannot be cut into blocks of {t}") for f in features}).drop("_short")


def daily(df: DataFrame, features: list[str], by: tuple[str, ...] = ("south_north", "west_east")) -> DataFrame:
    """By calendar date: most for ``*_max*``, least for ``*_min*``, sum for ``total_*``, mean for others; a clear-sky ratio is the ratio of sums."""
    out = []
    for f in features:
        if f == "clearsky_ratio":
            out.append(F.coalesce(F.try_divide(F.sum("ghi"), F.sum("clearsky_ghi")), F.lit(0.0)).alias(f))
        else:
            how = F.max if "_max" in f else F.min if "_min" in f else F.sum if f.startswith("total_") else F.avg
            out.append(how(f).alias(f))
    return df.groupBy(*by, F.to_date("time").alias("date")).agg(*out)


def reduce_daily(df: DataFrame, feature: str, method: str, by: tuple[str, ...] = ("gid",), decimals: int | None = None) -> DataFrame:
    """A site series by calendar date: avg, max, min or sum; the mean clear-sky ratio is the ratio of sums, 0 at night. ``decimals``: rounded half to even."""
    if feature == "clearsky_ratio" and method == "avg":
        daily_value = F.coalesce(F.try_divide(F.sum("ghi"), F.sum("clearsky_ghi")), F.lit(0.0))
    else:
        daily_value = {"avg": F.avg, "max": F.max, "min": F.min, "sum": F.sum}[method](feature)
    return df.groupBy(*by, F.to_date("time").alias("date")).agg((daily_value if decimals is None else F.bround(daily_value, decimals)).alias(feature))
