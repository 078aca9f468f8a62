"""Observed cells: features kept where a seeded draw says that a station reports, null elsewhere.

Draws are digests of the seed, the observation and the place or step, so a repeated task draws the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Coverage:
    """Shares of cells and of steps that are observed; a pair is the range that each observation's own share is drawn from."""

    space: float | tuple[float, float]
    time: float | tuple[float, float] = 1.0


def draw(*parts: Column | str | int) -> Column:
    """A number between 0 and 1 that follows from the parts' texts; null if a part is null."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, int) else F.col(p) if isinstance(p, str) else p for p in parts])
    known = [F.col(p) if isinstance(p, str) else p for p in parts if not isinstance(p, int)]
    value = (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    for k in known:
        value = F.when(k.isNotNull(), value)
    return value


def _share(given: float | tuple[float, float], drawn: Column) -> Column:
    low, high = given if isinstance(given, (tuple, list)) else (given, given)
    return F.least(F.greatest(F.lit(float(low)) + drawn * (float(high) - float(low)), F.lit(0.0)), F.lit(1.0))


def _reports(c: Coverage, seed: int, kind: str) -> Column:
    of = lambda what, *more: draw(seed, F.lit(f"{kind} {what}"), "obs", *more)
    return (of("cell", "south_north", "west_east") <= _share(c.space, of("space"))) & (of("step", "t_idx") <= _share(c.time, of("time")))


def observed(df: DataFrame, features: list[str], onshore: Coverage, offshore: Coverage | None = None, topography: str = "topography", seed: int = 42) -> DataFrame:
    """``df`` (obs, south_north, west_east, t_idx, features) with ``<feature>_obs``: the value where a station reports, else null.

    Within one observation a cell reports at the steps that report. With ``offshore`` cells whose ``topography`` is not
    above 0, or null, follow that coverage. Rows with a null key are not observed. Columns only: no shuffle.
    """
    seen = _reports(onshore, seed, "onshore")
    if offshore is not None:
        land = F.coalesce(F.col(topography) > 0, F.lit(False))
        seen = F.when(land, seen).otherwise(_reports(offshore, seed, "offshore"))
    return df.withColumns({f"{f}_obs": F.when(seen, F.col(f)) for f in features})
