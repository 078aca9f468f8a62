"""The grammar of feature names: ``base_100m``, ``base_500pa``, patterns ``base_(.*)``."""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalog import OUTPUT


@dataclass(frozen=True)
class Feature:
    name: str
    base: str
    height: float | None = None
    pressure: float | None = None

    @property
    def level(self) -> float | None:
        return self.height if self.height is not None else self.pressure


def parse_feature(name: str) -> Feature:
    """Base name and the height (m) or pressure (Pa) that the name ends with."""
    name = name.lower()
    found = re.fullmatch(r"(.+)_(\d+(?:\.\d+)?)(m|pa)", name)
    if not found:
        return Feature(name, name)
    base, number, unit = found.groups()
    return Feature(name, base, float(number) if unit == "m" else None, float(number) if unit == "pa" else None)


def basename_column(name: Column) -> Column:
    """The same base name, of a column of names."""
    return F.regexp_replace(F.lower(name), r"_\d+(\.\d+)?(m|pa)$", "")


def height_column(name: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(name), r"_(\d+)m$", 1), F.lit("")).cast("double")


def snake(name: str) -> str:
    """CamelCase in lower case with underscores."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def snake_column(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_"))


def choose(available: list[str], wanted: str | list[str]) -> list[str]:
    """Features named by ``all``, a name, or names and wildcards; unknown plain names raise."""
    if wanted == "all":
        return list(available)
    out: list[str] = []
    lower = {a.lower(): a for a in available}
    for w in [wanted] if isinstance(wanted, str) else wanted:
        hits = [a for low, a in lower.items() if fnmatch.fnmatch(low, w.lower())]
        if not hits and not any(c in w for c in "*?["):
            raise KeyError(f"no feature {w!r} among {sorted(available)}")
        out += [h for h in hits if h not in out]
    return out


def union_in_order(*groups: list[str]) -> list[str]:
    return list(dict.fromkeys(x for g in groups for x in g))


def output_names(features: list[str]) -> list[str]:
    """What u/v pairs are called once they are speed and direction."""
    out = []
    for f in features:
        found = re.fullmatch(r"([uv])_(.+)", f.lower())
        out.append(f"{'windspeed' if found[1] == 'u' else 'winddirection'}_{found[2]}" if found else f)
    return out


def limits(feature: str) -> tuple[float | None, float | None]:
    """Least and most value of a feature by its base name; an unknown one raises."""
    base = parse_feature(feature).base
    if base not in OUTPUT:
        raise KeyError(f"no limits known for {feature!r}")
    return OUTPUT[base][3], OUTPUT[base][4]


def resolution(text: str, enhance: int) -> str:
    """'30km' or '60min' made finer by a factor."""
    number, unit = re.fullmatch(r"(\d+(?:\.\d+)?)(\D+)", text).groups()
    fine = float(number) / enhance
    return f"{int(fine) if fine.is_integer() else fine}{unit}"
