"""Projections that bring any source to the canonical columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import catalog
from ..functions.scalars import clean, kelvin_to_celsius, wrap_longitude

KEYS = ("south_north", "west_east", "time")


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def rename_known(df: DataFrame, aliases: dict[str, str] | None = None, era: bool = False) -> DataFrame:
    """Known feature and coordinate names to ours; ``aliases`` come first."""
    known = {**catalog.COORD_NAMES, **catalog.FEATURE_NAMES, **(catalog.ERA_NAMES if era else {}), **{k.lower(): v for k, v in (aliases or {}).items()}}
    return df.withColumnsRenamed({c: known[c] for c in df.columns if c in known and known[c] not in df.columns})


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: clean(F.col(c)) for c in floats}) if floats else df


def standard_values(df: DataFrame, units: dict[str, str] | None = None) -> DataFrame:
    """NaN to null, kelvin to Celsius where ``units`` says K, longitudes to [-180, 180), times to timestamps."""
    df = nan_to_null(df)
    changes = {c: kelvin_to_celsius(F.col(c)) for c, u in (units or {}).items() if u == "K" and c in df.columns}
    if "longitude" in df.columns:
        changes["longitude"] = wrap_longitude(F.col("longitude"))
    if "time" in df.columns and isinstance(df.schema["time"].dataType, T.StringType):
        changes["time"] = F.to_timestamp("time")
    return df.withColumns(changes) if changes else df


def unscale(df: DataFrame, factors: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.col(c) / F.lit(float(f)) for c, f in factors.items() if c in df.columns})


def scale(df: DataFrame, factors: dict[str, float], whole: bool = True) -> DataFrame:
    """Multiplied for storage; whole numbers round half to even."""
    return df.withColumns({c: F.bround(F.col(c) * f).cast("int") if whole else F.col(c) * f for c, f in factors.items() if c in df.columns})


def grid_index(coordinates: DataFrame) -> DataFrame:
    """(south_north, west_east, latitude, longitude) of a regular grid: rows by falling latitude, columns by rising longitude.

    Only the different latitudes and longitudes are ranked, not the data.
    """
    lats = coordinates.select("latitude").distinct().withColumn("south_north", (F.row_number().over(Window.orderBy(F.desc("latitude"))) - 1).cast("int"))
    lons = coordinates.select("longitude").distinct().withColumn("west_east", (F.row_number().over(Window.orderBy("longitude")) - 1).cast("int"))
    return coordinates.select("latitude", "longitude").distinct().join(lats, "latitude").join(lons, "longitude").select("south_north", "west_east", "latitude", "longitude")


def level_index(df: DataFrame, level: str = "lev") -> DataFrame:
    """``level``: 0, 1, ... from the highest pressure down."""
    ranks = df.select(level).distinct().withColumn("level", (F.row_number().over(Window.orderBy(F.desc(level))) - 1).cast("int"))
    return df.drop("level").join(F.broadcast(ranks), level) if level != "level" else df


def standardize(df: DataFrame, aliases: dict[str, str] | None = None, units: dict[str, str] | None = None, factors: dict[str, float] | None = None, features: list[str] | str = "all") -> DataFrame:
    """All of the above in the order of a scan, then the wanted features behind the keys they have."""
    from ..functions.names import choose

    df = standard_values(rename_known(lower_names(unscale(lower_names(df), factors or {})), aliases), units).drop(*catalog.NOT_READ)
    first = [c for c in ("gid", "space", "south_north", "west_east", "latitude", "longitude", "time", "level", "lev") if c in df.columns]
    return df.select(*first, *choose([c for c in df.columns if c not in first], features))
