"""The whole path from files to features, as one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators import coarsen, raster, windows
from ..sources import scan, sinks
from .features import derive


@dataclass
class Handler:
    """Scan, crop, derive, roll, shift, coarsen, drop or fill gaps; nothing runs before the result is used (a roll counts the times first)."""

    features: list[str]
    load: list[str] | str = "all"
    registry: str = "base"
    target: tuple[float, float] | None = None
    shape: tuple[int, int] | None = None
    threshold: float | None = None
    times: tuple[int | None, int | None, int] = (None, None, 1)
    time_roll: int = 0  # steps that values move on, around the end
    time_shift: int = 0  # minutes added to the times
    coarsen_by: int = 1
    gaps: str | None = None  # 'mask' drops times, 'linear' or 'nearest' fill
    gaps_along: str = "t_idx"  # or south_north, west_east
    options: dict = field(default_factory=dict)
    after_crop: Callable[[DataFrame], DataFrame] | None = None
    after_derive: Callable[[DataFrame], DataFrame] | None = None

    def run(self, source: DataFrame, grid: DataFrame | None = None) -> DataFrame:
        df = source
        if self.target and self.shape:
            df = raster.crop(df, grid if grid is not None else df.select("south_north", "west_east", "latitude", "longitude").distinct(), self.target, self.shape, self.threshold)
        if self.times != (None, None, 1):
            df = raster.time_slice(df, *self.times)
        if self.after_crop:
            df = self.after_crop(df)
        df = derive(df, self.features, registry=self.registry, **self.options)
        if self.after_derive:
            df = self.after_derive(df)
        df = df.select("south_north", "west_east", "time", *self.features)
        if self.time_roll:
            indexed = raster.time_index(df)
            steps = df.select("time").distinct().count()
            df = windows.roll(indexed, self.features, self.time_roll, steps).drop("t_idx")
        if self.time_shift:
            df = windows.shift_time(df, self.time_shift)
        if self.coarsen_by > 1:
            df = coarsen.spatial(df, self.features, self.coarsen_by, strict=False)
        if self.gaps == "mask":
            df = raster.drop_null_steps(df, self.features)
        elif self.gaps:
            indexed = raster.time_index(df)
            for f in self.features:
                others = tuple(c for c in ("south_north", "west_east", "t_idx") if c != self.gaps_along)
                indexed = windows.interpolate_na(indexed, f, self.gaps_along, others, self.gaps)
            df = indexed.drop("t_idx")
        return df

    def from_files(self, spark: SparkSession, paths, cache: str | None = None, **options) -> DataFrame:
        """The same from files; with a cache pattern only missing features are computed, then all are read from it."""
        keys = ["south_north", "west_east", "time"]
        if cache is None:
            return self.run(scan.scan(spark, paths, self.load, **options))
        have, missing = scan.cached(spark, cache, self.features)
        if missing:
            part = Handler(**{**self.__dict__, "features": missing})
            sinks.write_features(part.run(scan.scan(spark, paths, self.load, **options)), cache, missing, keys)
        return scan.read_cached(spark, cache, self.features, keys)


#: Handlers by name, for configurations: each takes a handler's options.
HANDLERS: dict[str, Callable[..., Handler]] = {
    "base": Handler,
    "wind-sites": lambda **options: Handler(**{"registry": "wind_sites", **options}),
    "solar-sites": lambda **options: Handler(**{"registry": "solar_sites", **options}),
    "climate-model": lambda **options: Handler(**{"registry": "climate_model", **options}),
}


def register_handler(name: str, build: Callable[..., Handler]) -> None:
    HANDLERS[name] = build


def handler_by_name(name: str, **options) -> Handler:
    if name not in HANDLERS:
        raise ValueError(f"no handler {name!r}; known: {sorted(HANDLERS)}")
    return HANDLERS[name](**options)


def daily_pair(hourly: DataFrame, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """(daily, hourly) members of a data set."""
    return coarsen.daily(hourly, features), hourly
