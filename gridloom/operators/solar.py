"""Solar irradiance from clear-sky ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ratios below this are cloudy; sun below this zenith angle is up.
CLOUDY, NIGHT_ZENITH = 0.99, 90.0
SOLAR_CONSTANT = 1370.0


def disc_dni(ghi: Column, zenith: Column, doy: Column, pressure: Column) -> Column:
    """Direct irradiance by the published DISC model (Maxwell 1987), pressure in hPa."""
    day = 2 * 3.141592653589793 * (doy - 1) / 365
    distance = 1.00011 + 0.034221 * F.cos(day) + 0.00128 * F.sin(day) + 0.000719 * F.cos(2 * day) + 0.000077 * F.sin(2 * day)
    top = SOLAR_CONSTANT * distance
    cosine = F.greatest(F.cos(F.radians(zenith)), F.lit(0.065))
    kt = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ghi / (top * cosine)))
    mass = F.least(F.lit(12.0), 1 / (F.cos(F.radians(zenith)) + 0.15 * F.pow(F.greatest(93.885 - zenith, F.lit(1e-6)), F.lit(-1.253))) * pressure / 1013.25)
    k2, k3 = kt * kt, kt * kt * kt
    low = kt <= 0.6
    a = F.when(low, 0.512 - 1.56 * kt + 2.286 * k2 - 2.222 * k3).otherwise(-5.743 + 21.77 * kt - 27.49 * k2 + 11.56 * k3)
    b = F.when(low, 0.37 + 0.962 * kt).otherwise(41.4 - 118.5 * kt + 66.05 * k2 + 31.9 * k3)
    c = F.when(low, -0.28 + 0.932 * kt - 2.048 * k2).otherwise(-47.01 + 184.2 * kt - 222.0 * k2 + 73.81 * k3)
    fall = a + b * F.exp(c * mass)
    clear = 0.866 - 0.122 * mass + 0.0121 * mass * mass - 0.000653 * F.pow(mass, F.lit(3)) + 0.000014 * F.pow(mass, F.lit(4))
    dni = top * (clear - fall)
    return F.when((zenith < 87) & (ghi > 0), F.greatest(dni, F.lit(0.0))).otherwise(0.0)


def irradiance(df: DataFrame, bound: float | None = None) -> DataFrame:
    """ghi, dni and dhi from clearsky_ratio, clearsky_ghi, clearsky_dni, solar_zenith_angle and surface_pressure (hPa).

    Cells further than ``bound`` from their source (``distance``) get 0. At night all is 0.
    """
    inside = F.lit(True) if bound is None else F.col("distance") <= bound
    up = F.col("solar_zenith_angle") < NIGHT_ZENITH
    ghi = F.when(inside, F.col("clearsky_ghi") * F.col("clearsky_ratio")).otherwise(0.0)
    df = df.withColumn("ghi", ghi)
    cloudy = F.least(F.col("clearsky_dni"), disc_dni(F.col("ghi"), F.col("solar_zenith_angle"), F.dayofyear("time"), F.col("surface_pressure")))
    dni = F.when(F.col("clearsky_ratio") < CLOUDY, cloudy).otherwise(F.col("clearsky_dni"))
    df = df.withColumn("dni", F.when(inside & up, dni).otherwise(0.0))
    return df.withColumn("dhi", F.when(inside & up, F.greatest(F.lit(0.0), F.col("ghi") - F.col("dni") * F.cos(F.radians("solar_zenith_angle")))).otherwise(0.0))


def match_clearsky(sites: DataFrame, clearsky: DataFrame, k: int = 1, bound: float = 1.0) -> DataFrame:
    """(gid, doy, hour, clear-sky columns): mean of each site's ``k`` nearest clear-sky cells, by day of the year and hour."""
    from .neighbors import knn_join

    near = knn_join(sites, clearsky.select("gid", "latitude", "longitude").distinct(), k, bound)
    values = [c for c in clearsky.columns if c not in ("gid", "latitude", "longitude", "time")]
    joined = near.join(clearsky, F.col("tid") == F.col("gid"))
    return joined.groupBy(F.col("sid").alias("gid"), F.dayofyear("time").alias("doy"), F.hour("time").alias("hour")).agg(F.min("distance").alias("distance"), *[F.avg(v).alias(v) for v in values])


def daily_clearsky(cells: DataFrame, clearsky: DataFrame, k: int, bound: float) -> DataFrame:
    """Clear-sky irradiance of coarse cells by month and day (any year): nearest ``k`` cells, then daily mean; ``cells`` (gid, time) are joined by it."""
    from .neighbors import knn_join

    near = knn_join(cells.select("gid", "latitude", "longitude").distinct(), clearsky.select("gid", "latitude", "longitude").distinct(), k, bound)
    by_day = near.join(clearsky, F.col("tid") == F.col("gid")).groupBy(F.col("sid").alias("gid"), F.date_format("time", "MM.dd").alias("day")).agg(F.avg("clearsky_ghi").alias("clearsky_ghi"))
    return cells.withColumn("day", F.date_format("time", "MM.dd")).join(by_day, ["gid", "day"], "left").drop("day")


def scale_to_peak(df: DataFrame, ghi: str = "ghi", clearsky: str = "clearsky_ghi") -> DataFrame:
    """Clear-sky irradiance scaled so that its largest value at each cell is the irradiance's."""
    peaks = df.groupBy("south_north", "west_east").agg(F.try_divide(F.max(ghi), F.max(clearsky)).alias("_k"))
    return df.join(peaks, ["south_north", "west_east"]).withColumn(clearsky, F.col(clearsky) * F.col("_k")).drop("_k")


def temporal_sets(files: DataFrame, per_file: int = 24) -> DataFrame:
    """(t_chunk, s_chunk, file, files, start, stop): each chunk file with its neighbours in time, and which steps of the three are its own.

    ``files``: (t_chunk, s_chunk, file). Chunks follow each other by t_chunk, numbers may be left out; the first and the last have one neighbour.
    """
    along = Window.partitionBy("s_chunk").orderBy("t_chunk")
    before, behind = F.lag("file").over(along), F.lead("file").over(along)
    start = F.when(before.isNull(), 0).otherwise(per_file)
    sets = files.select("t_chunk", "s_chunk", "file", F.array_compact(F.array(before, F.col("file"), behind)).alias("files"), start.alias("start"))
    return sets.withColumn("stop", F.col("start") + per_file)


def to_utc_by_chunk(df: DataFrame, features: list[str], per_file: int = 24, ids: DataFrame | None = None) -> DataFrame:
    """Chunks of local hours (s_chunk, t_chunk, hour, gid, longitude, features) as hours of UTC, each from itself and its neighbours in time.

    A chunk and its neighbours are one axis of two or three days (one for a chunk alone), which is rolled by the whole hours of a site's longitude; of
    the rolled axis the chunk's own hours are kept. ``ids`` (t_chunk): only these are made; of the others what they need is read.
    """
    along = Window.partitionBy("s_chunk").orderBy("t_chunk")
    before, behind = F.lag("t_chunk").over(along), F.lead("t_chunk").over(along)
    order = df.select("s_chunk", "t_chunk").distinct().withColumn("_set", F.array_compact(F.array(before, F.col("t_chunk"), behind))).withColumn("_start", F.when(before.isNull(), 0).otherwise(per_file))
    wanted = order if ids is None else order.join(ids.select("t_chunk"), "t_chunk", "left_semi")
    members = wanted.select("s_chunk", F.col("t_chunk").alias("_target"), "_start", F.size("_set").alias("_n"), F.posexplode("_set").alias("_k", "t_chunk"))
    rolled = F.pmod(F.col("_k") * per_file + F.col("hour") - F.rint(F.col("longitude") / 15).cast("int"), F.col("_n") * per_file)
    sent = df.join(members, ["s_chunk", "t_chunk"]).withColumn("hour", rolled - F.col("_start")).where((F.col("hour") >= 0) & (F.col("hour") < per_file))
    return sent.select("s_chunk", F.col("_target").alias("t_chunk"), "gid", "longitude", "hour", *features)


def require(df: DataFrame, columns: tuple[str, ...] = ("clearsky_ghi", "clearsky_dni", "solar_zenith_angle", "surface_pressure")) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"solar data lack {missing}")


def require_hourly(df: DataFrame) -> None:
    """Raises unless the times follow each other by the hour."""
    from ..functions.times import time_step

    step = time_step(df).first()["step"]
    if step != 3600:
        raise ValueError(f"solar data need hourly times, not steps of {step} seconds")
