"""Time axes: steps, ranges, refinement, windows of the year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def leap_day(time: Column) -> Column:
    return (F.month(time) == 2) & (F.dayofmonth(time) == 29)


def encode(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")


def decode(text: Column) -> Column:
    return F.to_timestamp(text)


def deltas(df: DataFrame, time: str = "time") -> DataFrame:
    """(delta, n): seconds between successive different times, with their number. One row per time is sorted, none of the data."""
    steps = df.select(F.col(time).alias("t")).distinct().select((F.unix_timestamp("t") - F.unix_timestamp(F.lag("t").over(Window.orderBy("t")))).alias("delta"))
    return steps.where("delta is not null").groupBy("delta").agg(F.count("*").alias("n"))


def time_step(df: DataFrame, time: str = "time") -> DataFrame:
    """(step, nominal): the most frequent step (smallest on a tie) and the least; a day for a single time."""
    found = deltas(df, time).agg(F.min(F.struct((-F.col("n")).alias("n"), "delta"))["delta"].alias("step"), F.min("delta").alias("nominal"))
    return found.select(F.coalesce("step", F.lit(86400)).alias("step"), F.coalesce("nominal", F.lit(86400)).alias("nominal"))


def time_range(spark: SparkSession, start: str, end: str, step: str, drop_leap: bool = False) -> DataFrame:
    """(t_idx, time) from start to end, both included."""
    times = spark.sql(f"select posexplode(sequence(timestamp'{start}', timestamp'{end}', interval {step})) as (t_idx, time)")
    if drop_leap:
        times = times.where(~leap_day(F.col("time"))).withColumn("t_idx", F.row_number().over(Window.orderBy("time")) - 1)
    return times


def range_of(df: DataFrame, time: str = "time") -> dict:
    """start, end, step in seconds and drop_leap of a regular series of times, as :func:`time_range` takes them.

    A day missing at the end of February of a leap year counts as dropped; any other uneven step raises, and so does a table without times.
    """
    ordered = Window.orderBy("at")  # different times only
    steps = df.select(F.col(time).alias("at")).where("at is not null").distinct().withColumn("before", F.lag("at").over(ordered))
    steps = steps.withColumn("delta", F.unix_timestamp("at") - F.unix_timestamp("before"))
    one = steps.agg(F.min("at").alias("start"), F.max("at").alias("end"), F.min("delta").alias("step")).first()
    if one["start"] is None:
        raise ValueError("no times")
    step = one["step"] or 86400
    over_leap_day = leap_day(F.timestamp_seconds(F.unix_timestamp("before") + step)) & (F.col("delta") == step + 86400)
    uneven = steps.where((F.col("delta") != step) & ~over_leap_day).count()
    if uneven:
        raise ValueError(f"{uneven} steps differ from {step} seconds")
    return {"start": str(one["start"]), "end": str(one["end"]), "step": f"{step} second", "drop_leap": not steps.where((F.col("delta") != step) & over_leap_day).isEmpty()}


def refine(df: DataFrame, factor: int, time: str = "time") -> DataFrame:
    """(time, part, fine_time): each different time cut into ``factor`` equal parts; Feb 29 only if the input has it."""
    times = df.select(time).distinct()
    step = time_step(times, time)
    had_leap = times.agg(F.coalesce(F.bool_or(leap_day(F.col(time))), F.lit(False)).alias("had_leap"))
    cut = times.crossJoin(F.broadcast(step)).crossJoin(F.broadcast(had_leap))
    fine = cut.select(time, "had_leap", "step", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))).alias("part"))
    at = F.timestamp_seconds(F.unix_timestamp(time) + F.col("part") * F.col("step") / factor)
    return fine.withColumn("fine_time", at).where(F.col("had_leap") | ~leap_day(F.col("fine_time"))).select(time, "part", "fine_time")


def window_centers(n: int) -> list[float]:
    """Centres of ``n`` windows over the year."""
    width = 365 / n
    out, at = [], width / 2
    while at < 366:
        out.append(at)
        at += width
    return out


def in_window(doy: Column, center: Column, size: float) -> Column:
    """Whether a day of the year is strictly within half a window of the centre, around the turn of the year."""
    lo, hi = center - size / 2, center + size / 2
    return F.when(lo < 0, (doy > 365 + lo) | (doy < hi)).when(hi > 365, (doy > lo) | (doy < hi - 365)).otherwise((doy > lo) & (doy < hi))


def nearest_window(doy: Column, n: int) -> Column:
    """Index of the nearest centre, not around the turn of the year; the first on a tie."""
    centers = window_centers(n)
    pairs = [F.struct(F.abs(doy - F.lit(c)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centers)]
    return F.least(*pairs)["i"] if len(pairs) > 1 else F.lit(0)
