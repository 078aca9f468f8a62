"""Deriving features by name: a registry of patterns, resolved on the driver into columns.

A rule is a function (context) to a Column, with the features it needs; or the name of
another feature, ``(.*)`` standing for the height or pressure. What no rule gives and no column
holds is taken from a profile at its level.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.names import Feature, parse_feature
from ..operators import profiles


@dataclass(frozen=True)
class Rule:
    inputs: tuple[str, ...]
    column: Callable[[Feature, dict[str, Column]], Column]


def _theta(c: dict[str, Column]) -> Column | float:
    return c.get("theta", 0.0)


def _height(f: Feature, name: str) -> str:
    return name.replace("*", re.sub(r"^[a-z_]+?_(?=\d)", "", f.name))


BASE: dict[str, Rule | str] = {
    "windspeed_(.*)": Rule(("u_*", "v_*"), lambda f, c: S.speed(c[_height(f, "u_*")], c[_height(f, "v_*")], _theta(c))),
    "winddirection_(.*)": Rule(("u_*", "v_*"), lambda f, c: S.direction(c[_height(f, "u_*")], c[_height(f, "v_*")], _theta(c))),
    "u_(.*)": Rule(("windspeed_*", "winddirection_*"), lambda f, c: S.u_wind(c[_height(f, "windspeed_*")], c[_height(f, "winddirection_*")], _theta(c))),
    "v_(.*)": Rule(("windspeed_*", "winddirection_*"), lambda f, c: S.v_wind(c[_height(f, "windspeed_*")], c[_height(f, "winddirection_*")], _theta(c))),
    "relativehumidity_2m": Rule(("temperature_2m", "d2m"), lambda f, c: S.surface_rh(c["temperature_2m"], c["d2m"])),
    "cloud_mask": Rule(("ghi", "clearsky_ghi", "night"), lambda f, c: S.cloud_mask(c["ghi"], c["clearsky_ghi"], c["night"])),
    "clearsky_ratio": Rule(("ghi", "clearsky_ghi", "night"), lambda f, c: S.clearsky_ratio(c["ghi"], c["clearsky_ghi"], c["night"])),
    "pressure": Rule(("p", "pb"), lambda f, c: c["p"] + c["pb"]),
    "sza": Rule(("time", "latitude", "longitude"), lambda f, c: S.solar_zenith(c["time"], c["latitude"], c["longitude"])),
    "latitude_feature": Rule(("latitude",), lambda f, c: c["latitude"]),
    "longitude_feature": Rule(("longitude",), lambda f, c: c["longitude"]),
    "sod_encoding": Rule(("time",), lambda f, c: S.sod_encoding(c["time"])),
    "soy_encoding": Rule(("time",), lambda f, c: S.soy_encoding(c["time"])),
}
WIND_SITES = {**BASE, "temperature_max_(.*)m": "temperature_(.*)m", "temperature_min_(.*)m": "temperature_(.*)m", "relativehumidity_max_(.*)m": "relativehumidity_(.*)m", "relativehumidity_min_(.*)m": "relativehumidity_(.*)m"}
SOLAR_SITES = {
    **WIND_SITES,
    "windspeed": "wind_speed",
    "winddirection": "wind_direction",
    "u": Rule(("windspeed", "winddirection"), lambda f, c: S.u_wind(c["windspeed"], c["winddirection"], _theta(c))),
    "v": Rule(("windspeed", "winddirection"), lambda f, c: S.v_wind(c["windspeed"], c["winddirection"], _theta(c))),
}
CLIMATE_MODEL = {
    **BASE,
    "u_(.*)": "ua_(.*)",
    "v_(.*)": "va_(.*)",
    "relativehumidity_2m": "hurs",
    "relativehumidity_min_2m": "hursmin",
    "relativehumidity_max_2m": "hursmax",
    "clearsky_ratio": Rule(("rsds", "clearsky_ghi"), lambda f, c: S.clearsky_ratio_daily(c["rsds"], c["clearsky_ghi"])),
    "temperature_2m": Rule(("tas",), lambda f, c: S.kelvin_to_celsius(c["tas"])),
    "temperature_max_2m": Rule(("tasmax",), lambda f, c: S.kelvin_to_celsius(c["tasmax"])),
    "temperature_min_2m": Rule(("tasmin",), lambda f, c: S.kelvin_to_celsius(c["tasmin"])),
    "temperature_(.*)": Rule(("ta_*",), lambda f, c: S.kelvin_to_celsius(c[_height(f, "ta_*")])),
    "pressure_(.*)": "level_(.*)",
}
POWER_LAW = {
    **CLIMATE_MODEL,
    "u_(.*)": Rule(("uas",), lambda f, c: S.power_law(c["uas"], f.height or 10.0)),
    "v_(.*)": Rule(("vas",), lambda f, c: S.power_law(c["vas"], f.height or 10.0)),
}
REGISTRIES = {"base": BASE, "wind_sites": WIND_SITES, "solar_sites": SOLAR_SITES, "climate_model": CLIMATE_MODEL, "power_law": POWER_LAW}


def find_rule(name: str, registry: dict[str, Rule | str]) -> Rule | str | None:
    """The exact name first, then the first pattern that fits; an alias has its wildcard filled in."""
    name = name.lower()
    if name in registry:
        return registry[name]
    for pattern, rule in registry.items():
        found = re.fullmatch(pattern, name) if "(.*)" in pattern else None
        if found:
            return rule.replace("(.*)", found[1]) if isinstance(rule, str) else rule
    return None


class Deriver:
    """Adds features to a frame in the order their inputs allow; ``profile`` (keys, lev, features) serves levels."""

    def __init__(self, df: DataFrame, registry: dict[str, Rule | str] | str = "base", profile: DataFrame | None = None, method: str = "linear", keys: tuple[str, ...] = ("south_north", "west_east", "time")):
        self.df, self.profile, self.method, self.keys = df, profile, method, keys
        self.registry = REGISTRIES[registry] if isinstance(registry, str) else registry

    def _has(self, name: str) -> bool:
        return name.lower() in (c.lower() for c in self.df.columns)

    def _from_profile(self, f: Feature) -> bool:
        if self.profile is None or f.level is None or f.base not in self.profile.columns:
            return False
        samples = self.profile.select(*self.keys, "lev", f.base)
        singles = {g.height: c for c in self.df.columns if (g := parse_feature(c)).base == f.base and g.height is not None and f.height is not None}
        if singles:
            samples = profiles.with_single_levels(samples, self.df, singles, f.base, self.keys)
        value = profiles.interpolate(samples, f.base, f.level, self.method, self.keys).withColumnRenamed(f.base, f.name)
        self.df = self.df.join(value, list(self.keys), "left")
        return True

    def derive(self, name: str, pending: tuple[str, ...] = ()) -> bool:
        name = name.lower()
        if self._has(name):
            return True
        f, rule = parse_feature(name), find_rule(name, self.registry)
        if rule is not None and name not in pending:
            if isinstance(rule, str):
                if self.derive(rule, (*pending, name)):
                    self.df = self.df.withColumn(name, F.col(rule))
                    return True
            else:
                inputs = [_height(f, i) if "*" in i else i for i in rule.inputs]
                if not any(i in pending for i in inputs) and all(self.derive(i, (*pending, name)) for i in inputs):
                    self.df = self.df.withColumn(name, rule.column(f, {c.lower(): F.col(c) for c in self.df.columns}))
                    return True
        return self._from_profile(f)


def derive(df: DataFrame, features: list[str], **options) -> DataFrame:
    """``df`` with all the features; one that cannot be had raises."""
    deriver = Deriver(df, **options)
    for f in features:
        if not deriver.derive(f):
            raise KeyError(f"cannot derive {f!r} from {df.columns}")
    return deriver.df
