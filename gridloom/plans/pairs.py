"""Coarse and fine members of one training data set, and exogenous fields for each model step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import time_step
from ..operators import coarsen, neighbors, stats, windows
from ..operators.grid import repeat_in_time


@dataclass
class Pair:
    low: DataFrame
    high: DataFrame
    observed: DataFrame | None = None


def check_steps(low: DataFrame, high: DataFrame, t_enhance: int) -> None:
    """The coarse time step must be ``t_enhance`` fine ones."""
    a, b = (time_step(df).first()["step"] for df in (low, high))
    if a != b * t_enhance:
        raise ValueError(f"steps of {a} s and {b} s are not {t_enhance} to 1")


def pair(low: DataFrame, high: DataFrame, features: list[str], rows: int, columns: int, s: int, t: int, regrid: bool = True, k: int = 4, bound: float = 1.0, most_missing: float = 10.0) -> Pair:
    """Members that fit: fine rows trimmed to whole blocks, coarse values put on the fine grid's blocks.

    Coarse gaps of less than ``most_missing`` per cent are filled from the nearest cells; more raise.
    """
    check_steps(low, high, t)
    fine = coarsen.trim(high, rows, columns, s)
    if regrid:
        blocks = coarsen.spatial(fine.select("south_north", "west_east", "latitude", "longitude").distinct(), ["latitude", "longitude"], s, by=())
        blocks = blocks.withColumn("gid", (F.col("south_north") * (columns // s) + F.col("west_east")).cast("long"))
        points = low.select(F.xxhash64("south_north", "west_east").alias("gid"), "latitude", "longitude", "time", *features)
        low = neighbors.regrid(points, blocks, features, k, bound).join(blocks.withColumnRenamed("gid", "cell"), "cell").drop("cell")
    share = {r["feature"]: r["nan_perc"] for r in stats.qa_table(low, features).collect()}
    for f, missing in share.items():
        if missing >= most_missing:
            raise ValueError(f"{missing:.1f} % of {f} is missing")
        if missing:
            low = windows.fill_nearest(low, f)
    return Pair(low, fine)


@dataclass(frozen=True)
class ExoStep:
    """One exogenous field for one model: how it is combined and how fine it is against the input."""

    feature: str
    model: int
    combine: str  # input, layer or output
    s_enhance: int
    t_enhance: int


def exo_steps(feature: str, steps: list[tuple[int, str]], s_enhancements: list[int], t_enhancements: list[int]) -> list[ExoStep]:
    """(model, combine) pairs with their total refinement: that of all models before it, and of its own for layers and outputs."""
    out = []
    for model, combine in steps:
        if combine not in ("input", "layer", "output"):
            raise ValueError(f"cannot combine as {combine!r}")
        upto = model if combine == "input" else model + 1
        s, t = 1, 1
        for a, b in zip(s_enhancements[:upto], t_enhancements[:upto], strict=True):
            s, t = s * a, t * b
        out.append(ExoStep(feature, model, combine, s, t))
    return out


def exo_field(source: DataFrame, target: DataFrame, feature: str, bound: float, scale: float = 1.0, times: DataFrame | None = None) -> DataFrame:
    """A field on the target grid (gid, south_north, west_east, latitude, longitude): mean of the nearest source points, gaps from the nearest cell."""
    by_time = "time" in source.columns
    mean = neighbors.group_mean(source, target, [feature], bound, by_time)
    placed = mean.join(target.select("gid", "south_north", "west_east"), "gid").withColumn(feature, F.col(feature) * scale)
    if not by_time:
        placed = placed.withColumn("_one", F.lit(0))
    filled = windows.fill_nearest(placed, feature, ("time",) if by_time else ("_one",)).drop("_one")
    return filled if by_time or times is None else repeat_in_time(filled, times)


def steps_of(steps: list[ExoStep], model: int, combine: str | None = None) -> list[ExoStep]:
    return [s for s in steps if s.model == model and combine in (None, s.combine)]


def split_steps(steps: list[ExoStep], first_models: int) -> tuple[list[ExoStep], list[ExoStep]]:
    """Steps of the first models and of the rest; the rest count their models from 0."""
    early = [s for s in steps if s.model < first_models]
    late = [ExoStep(s.feature, s.model - first_models, s.combine, s.s_enhance, s.t_enhance) for s in steps if s.model >= first_models]
    return early, late
