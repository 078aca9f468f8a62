"""Values at a height or pressure from profiles, and single-level values among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.levels import METHODS


def with_single_levels(profile: DataFrame, surface: DataFrame, by_level: dict[float, str], feature: str, keys: tuple[str, ...] = ("south_north", "west_east", "time")) -> DataFrame:
    """The profile (keys, lev, feature) with single-level columns as further rows at their levels."""
    out = profile.select(*keys, "lev", feature)
    for level, column in by_level.items():
        out = out.unionByName(surface.select(*keys, F.lit(float(level)).alias("lev"), F.col(column).alias(feature)))
    return out


def interpolate(profile: DataFrame, feature: str, level: float, method: str = "linear", keys: tuple[str, ...] = ("south_north", "west_east", "time"), strict: bool = False) -> DataFrame:
    """The feature at a level: from the nearest sample below and the nearest at or above, or the two nearest on one side.

    One aggregation by cell and time picks all four candidates; nothing is sorted. ``strict``: a cell that gets no value raises
    when it is computed.
    """
    sample = F.struct("lev", F.col(feature).alias("v"))
    full = F.col("lev").isNotNull() & F.col(feature).isNotNull()
    usable = profile.withColumns({"lev": F.when(full, F.col("lev")), feature: F.when(full, F.col(feature))}) if strict else profile.where(full)
    below, above = F.col("lev") < level, F.col("lev") >= level
    picked = usable.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(below, sample)), False).alias("b"), F.sort_array(F.collect_list(F.when(above, sample))).alias("a"))
    first = F.coalesce(F.get("b", 0), F.get("a", 1), F.get("a", 0))
    second = F.coalesce(F.get("a", 0), F.get("b", 1), F.get("b", 0))
    pair = picked.select(*keys, first.alias("p"), second.alias("q"))
    value = METHODS[method](F.col("p.lev"), F.col("q.lev"), F.col("p.v"), F.col("q.v"), level)
    if strict:
        value = F.coalesce(value, F.raise_error(F.lit(f"{feature} has no value at level {level}")).cast("double"))
    return pair.select(*keys, value.alias(feature))


def height_above_ground(df: DataFrame, geopotential_height: str = "zg", topography: str = "topography") -> DataFrame:
    return df.withColumn("lev", F.col(geopotential_height) - F.col(topography))


def era_heights(df: DataFrame) -> DataFrame:
    """Geopotential to metres, pressure levels to pascals."""
    return df.withColumns({"zg": F.col("z") / 9.81, "pressure": 100 * F.col("level")})


def check_levels(profile: DataFrame, level: float, keys: tuple[str, ...] = ("south_north", "west_east", "time")) -> DataFrame:
    """(cells, not_covered, with_gaps): how many profiles do not reach to both sides of the level, or have nulls."""
    each = profile.groupBy(*keys).agg(F.min("lev").alias("lo"), F.max("lev").alias("hi"), F.bool_or(F.col("lev").isNull()).alias("gap"))
    outside = (F.col("lo") > level) | (F.col("hi") < level) | F.col("lo").isNull()
    return each.agg(F.count("*").alias("cells"), F.count_if(outside).alias("not_covered"), F.count_if("gap").alias("with_gaps"))


def monthly_means_to_heights(means: DataFrame, heights: list[float], keys: tuple[str, ...] = ("month", "latitude", "longitude")) -> DataFrame:
    """(keys, height, ws): monthly means (keys, height, ws) interpolated to heights; -999 is missing."""
    profile = means.where((F.col("ws") > -999) & F.col("ws").isNotNull()).select(*keys, F.col("height").cast("double").alias("lev"), "ws")
    samples = profile.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("lev", "ws"))).alias("s"))
    wanted = samples.select(*keys, "s", F.explode(F.array(*[F.lit(float(h)) for h in heights])).alias("height")).where(F.size("s") >= 2)
    k = F.greatest(F.lit(1), F.least(F.size("s") - 1, F.size(F.filter("s", lambda p: p["lev"] <= F.col("height")))))
    p, q = F.get("s", k - 1), F.get("s", k)
    value = p["ws"] + (F.col("height") - p["lev"]) * F.try_divide(q["ws"] - p["ws"], q["lev"] - p["lev"])
    return wanted.select(*keys, "height", value.alias("ws"))
