"""Derived quantities as column expressions; all stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import limits

#: Standard atmosphere and lapse rate.
SEA_LEVEL_PA, SCALE_HEIGHT_M, PRESSURE_POWER, LAPSE_C_PER_KM = 101325.0, 44307.69231, 5.25328, 6.5


def clean(x: Column) -> Column:
    """NaN is missing, and missing is null."""
    return F.when(~F.isnan(x), x)


def kelvin_to_celsius(x: Column) -> Column:
    return x - 273.15


def wrap_longitude(lon: Column) -> Column:
    """To [-180, 180)."""
    return F.pmod(lon + 180, F.lit(360)) - 180


def vapour_pressure(celsius: Column) -> Column:
    return 6.1078 * F.exp(17.1 * celsius / (235 + celsius))


def surface_rh(temperature: Column, dewpoint: Column) -> Column:
    return F.try_divide(100 * vapour_pressure(dewpoint), vapour_pressure(temperature))


def speed(u: Column, v: Column, theta: Column | float = 0.0) -> Column:
    """Wind speed of components on a grid rotated by ``theta`` (radians)."""
    a, b = unrotate(u, v, theta)
    return F.hypot(a, b)


def direction(u: Column, v: Column, theta: Column | float = 0.0) -> Column:
    a, b = unrotate(u, v, theta)
    return F.pmod(F.degrees(F.atan2(a, b)) + 360, F.lit(360.0))


def unrotate(u: Column, v: Column, theta: Column | float) -> tuple[Column, Column]:
    if isinstance(theta, float) and theta == 0:
        return u, v
    theta = theta if isinstance(theta, Column) else F.lit(theta)
    return F.cos(theta) * u - F.sin(theta) * v, F.sin(theta) * u + F.cos(theta) * v


def u_wind(speed: Column, direction: Column, theta: Column | float = 0.0) -> Column:
    theta = theta if isinstance(theta, Column) else F.lit(theta)
    d = F.radians(direction)
    return F.cos(theta) * speed * F.sin(d) + F.sin(theta) * speed * F.cos(d)


def v_wind(speed: Column, direction: Column, theta: Column | float = 0.0) -> Column:
    theta = theta if isinstance(theta, Column) else F.lit(theta)
    d = F.radians(direction)
    return F.cos(theta) * speed * F.cos(d) - F.sin(theta) * speed * F.sin(d)


def from_direction(speed: Column, direction: Column) -> tuple[Column, Column]:
    """Components of a wind named by where it comes from, without rotation."""
    return -speed * F.sin(F.radians(direction)), -speed * F.cos(F.radians(direction))


def power_law(near_surface: Column, height: float, reference: float = 10.0, exponent: float = 0.2) -> Column:
    return near_surface * math.pow(height / reference, exponent)


def log_law(z: Column, a: float, b: float, c: float) -> Column:
    return a * F.log(z + b) + c


def clip(x: Column, least: float | None, most: float | None) -> Column:
    """Like numpy's clip: nulls stay null."""
    bound = x
    if least is not None:
        bound = F.greatest(bound, F.lit(float(least)))
    if most is not None:
        bound = F.least(bound, F.lit(float(most)))
    return F.when(x.isNotNull(), bound)


def enforce(feature: str, x: Column, drop: bool = False) -> Column:
    """A feature held to its limits, or null outside them (to be filled from neighbours) with ``drop``."""
    least, most = limits(feature)
    return F.when(clip(x, least, most) == x, x) if drop else clip(x, least, most)


def clearsky_ratio(ghi: Column, clearsky: Column, night: Column) -> Column:
    return F.when(~night, F.try_divide(ghi, clearsky))


def clearsky_ratio_daily(rsds: Column, clearsky: Column) -> Column:
    return clip(F.try_divide(rsds, clearsky), 0, 1)


def cloud_mask(ghi: Column, clearsky: Column, night: Column) -> Column:
    return F.when(~night, (ghi < clearsky).cast("double"))


def encoding(k: Column, d: float, i: int = 1) -> Column:
    """sin (even i) or cos (odd i) of 2 pi (i + 1) k / d."""
    angle = 2 * math.pi * (i + 1) * k / d
    return F.sin(angle) if i % 2 == 0 else F.cos(angle)


def second_of_day(time: Column) -> Column:
    return F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)


def second_of_year(time: Column) -> Column:
    return (F.dayofyear(time) - 1) * 86400 + second_of_day(time)


def sod_encoding(time: Column, i: int = 1) -> Column:
    return encoding(second_of_day(time), 86400.0, i)


def soy_encoding(time: Column, i: int = 1) -> Column:
    return encoding(second_of_year(time), 31536000.0, i)


def pressure_at(topography: Column) -> Column:
    """Standard pressure (Pa) at a height."""
    return SEA_LEVEL_PA * F.pow(F.lit(1.0) - topography / SCALE_HEIGHT_M, F.lit(PRESSURE_POWER))


def pressure_drop(topography: Column) -> Column:
    """How much the standard pressure falls from sea level to a height."""
    return SEA_LEVEL_PA * (F.lit(1.0) - F.pow(F.lit(1.0) - topography / SCALE_HEIGHT_M, F.lit(PRESSURE_POWER)))


def solar_zenith(time: Column, latitude: Column, longitude: Column) -> Column:
    """Solar zenith angle in degrees by the low-precision almanac formulas, refraction included."""
    n = F.datediff(time, F.lit("2000-01-01")) - 0.5 + second_of_day(time) / 86400.0  # days from Greenwich noon, 2000-01-01
    hour = second_of_day(time) / 3600.0
    mean_long = F.radians(F.pmod(280.460 + 0.9856474 * n, F.lit(360.0)))
    anomaly = F.radians(F.pmod(357.528 + 0.9856003 * n, F.lit(360.0)))
    ecliptic = mean_long + F.radians(1.915 * F.sin(anomaly) + 0.020 * F.sin(2 * anomaly))
    tilt = F.radians(23.439 - 0.0000004 * n)
    ascension = F.atan2(F.cos(tilt) * F.sin(ecliptic), F.cos(ecliptic))
    declination = F.asin(F.sin(tilt) * F.sin(ecliptic))
    sidereal = F.pmod(6.697375 + 0.0657098242 * n + hour, F.lit(24.0))
    angle = F.radians(F.pmod(sidereal + longitude / 15.0, F.lit(24.0)) * 15.0) - ascension
    lat = F.radians(latitude)
    sine = F.sin(declination) * F.sin(lat) + F.cos(declination) * F.cos(lat) * F.cos(angle)
    elevation = F.degrees(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), sine))))
    lifted = F.when(
        elevation >= -0.56, 3.51561 * (0.1594 + 0.0196 * elevation + 0.00002 * elevation * elevation) / (1 + 0.505 * elevation + 0.0845 * elevation * elevation)
    ).otherwise(F.lit(0.56))
    return 90 - F.least(F.lit(90.0), elevation + lifted)
