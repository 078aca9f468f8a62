"""Training losses between a true and a generated cube, as aggregates.

Both cubes have (obs, south_north, west_east, t_idx) and the features; :func:`pair` joins
them as ``f`` and ``f_hat``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import dense
from .windows import derivative

CELL = ("obs", "south_north", "west_east", "t_idx")


def pair(true: DataFrame, fake: DataFrame, features: list[str]) -> DataFrame:
    return true.select(*CELL, *features).join(fake.select(*CELL, *[F.col(f).alias(f"{f}_hat") for f in features]), list(CELL))


#: Errors of single values by name.
POINTWISE = {"mae": lambda a, b: F.abs(a - b), "mse": lambda a, b: (a - b) * (a - b), "exp": lambda a, b: 1 - F.exp(-(a - b) * (a - b))}


def _mean(features: list[str], name: str) -> Column:
    """Mean over all cells and features."""
    means = [F.avg(POINTWISE[name](F.col(f), F.col(f"{f}_hat"))) for f in features]
    return sum(means[1:], means[0]) / len(means)


def mae(both: DataFrame, features: list[str]) -> DataFrame:
    return both.agg(_mean(features, "mae").alias("loss"))


def mse(both: DataFrame, features: list[str]) -> DataFrame:
    return both.agg(_mean(features, "mse").alias("loss"))


def exp_loss(both: DataFrame, features: list[str]) -> DataFrame:
    return both.agg(_mean(features, "exp").alias("loss"))


def coarse_mse(both: DataFrame, features: list[str]) -> DataFrame:
    """Of the means over space."""
    means = both.groupBy("obs", "t_idx").agg(*[F.avg(c).alias(c) for f in features for c in (f, f"{f}_hat")])
    return mse(means, features)


def extremes(both: DataFrame, features: list[str], over: tuple[str, ...]) -> DataFrame:
    """Half the error of the least plus half of the most, over space or over time."""
    rest = [c for c in CELL if c not in over]
    ends = both.groupBy(*rest).agg(*[e(c).alias(f"{n}_{c}") for f in features for c in (f, f"{f}_hat") for n, e in (("low", F.min), ("high", F.max))])
    return mae(ends, [f"{n}_{f}" for f in features for n in ("low", "high")])


def spatial_extremes(both: DataFrame, features: list[str]) -> DataFrame:
    return extremes(both, features, ("south_north", "west_east"))


def temporal_extremes(both: DataFrame, features: list[str]) -> DataFrame:
    return extremes(both, features, ("t_idx",))


def _derived(both: DataFrame, features: list[str], axes: tuple[str, ...]) -> DataFrame:
    out = both
    for axis in axes:
        by = tuple(c for c in CELL if c != axis)
        for f in features:
            out = derivative(derivative(out, f, axis, by), f"{f}_hat", axis, by)
    return out


def derivative_loss(both: DataFrame, features: list[str], axes: tuple[str, ...]) -> DataFrame:
    """Mean absolute error of the derivatives along the axes."""
    return _derived(both, features, axes).agg(_slope_error(features, axes).alias("loss"))


def _slope_error(features: list[str], axes: tuple[str, ...]) -> Column:
    errors = [F.avg(F.abs(F.col(f"{f}_d_{a}") - F.col(f"{f}_hat_d_{a}"))) for f in features for a in axes]
    return sum(errors[1:], errors[0]) / len(errors)


def _flow_error(u: str, v: str) -> Column:
    flow = lambda f, h: F.col(f"{f}{h}_d_t_idx") + F.col(f"{u}{h}") * F.col(f"{f}{h}_d_south_north") + F.col(f"{v}{h}") * F.col(f"{f}{h}_d_west_east")
    errors = [F.avg(F.abs(flow(f, "") - flow(f, "_hat"))) for f in (u, v)]
    return (errors[0] + errors[1]) / 2


def spatial_derivative(both: DataFrame, features: list[str]) -> DataFrame:
    return derivative_loss(both, features, ("south_north", "west_east"))


def temporal_derivative(both: DataFrame, features: list[str]) -> DataFrame:
    return derivative_loss(both, features, ("t_idx",))


def material_derivative(both: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Of d/dt + u d/dx + v d/dy of both components; rows are x."""
    return _derived(both, [u, v], ("t_idx", "south_north", "west_east")).agg(_flow_error(u, v).alias("loss"))


#: Observations of a batch that are compared pair by pair at most.
MOST_IN_BATCH = 1024


def low_res(both: DataFrame, features: list[str], s: int, loss: Callable = mae, t: int = 1, t_method: str = "average", extremes: Callable | None = None) -> DataFrame:
    """Any loss after both cubes are coarsened in space and time, with a loss of extremes on the same cubes added if given."""
    from .coarsen import spatial, temporal

    columns = [c for f in features for c in (f, f"{f}_hat")]
    coarse = spatial(both, columns, s, by=("obs", "t_idx"))
    if t > 1:
        coarse = temporal(coarse, columns, t, t_method, by=("obs", "south_north", "west_east")).withColumnRenamed("t_block", "t_idx")
    if extremes is None:
        return loss(coarse, features)
    more = extremes(coarse, features).withColumnRenamed("loss", "_more")
    return loss(coarse, features).crossJoin(F.broadcast(more)).select((F.col("loss") + F.col("_more")).alias("loss"))


def mmd(both: DataFrame, feature: str, sigma: float = 1.0) -> DataFrame:
    """Maximum mean discrepancy with a gaussian kernel over all pairs of a batch's observations, each a vector of cells.

    More than MOST_IN_BATCH observations raise.
    """
    if both.select("obs").distinct().limit(MOST_IN_BATCH + 1).count() > MOST_IN_BATCH:
        raise ValueError(f"more than {MOST_IN_BATCH} observations in a batch")
    vectors = both.groupBy("obs").agg(*[F.transform(F.array_sort(F.collect_list(F.struct("south_north", "west_east", "t_idx", F.col(c).alias("x")))), lambda s: s["x"]).alias(n) for c, n in ((feature, "a"), (f"{feature}_hat", "b"))])
    other = vectors.select(F.col("a").alias("a2"), F.col("b").alias("b2"))
    distance = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d)
    kernel = lambda x, y: F.exp(-distance(x, y) / (2 * sigma * sigma))
    pairs = vectors.crossJoin(other)
    return pairs.agg((F.avg(kernel("a", "a2")) + F.avg(kernel("b", "b2")) - 2 * F.avg(kernel("a", "b2"))).alias("loss"))


def fft_loss(both: DataFrame, feature: str, temporal: bool = False) -> DataFrame:
    """Mean absolute error of log amplitudes of each observation's (or each time's) Fourier transform."""
    keys = ["obs"] if temporal else ["obs", "t_idx"]
    axes = ["south_north", "west_east", "t_idx"][: 3 if temporal else 2]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        amplitude = [np.log1p(np.abs(np.fft.fftn(dense(pdf, axes, c)))) for c in (feature, f"{feature}_hat")]
        return pd.DataFrame({"error": [float(np.abs(amplitude[0] - amplitude[1]).mean())]})

    return both.groupBy(*keys).applyInPandas(run, "error double").agg(F.avg("error").alias("loss"))


def sliced_wasserstein(both: DataFrame, feature: str, projections: int = 64, seed: int = 42) -> DataFrame:
    """Mean squared distance of sorted random projections of each observation's fields."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (dense(pdf, ["t_idx", "south_north", "west_east"], c) for c in (feature, f"{feature}_hat"))
        a, b = a.reshape(len(a), -1), b.reshape(len(b), -1)
        directions = np.random.default_rng(seed).normal(size=(a.shape[1], projections))
        directions /= np.linalg.norm(directions, axis=0)
        return pd.DataFrame({"error": [float(((np.sort(a @ directions, 0) - np.sort(b @ directions, 0)) ** 2).mean())]})

    return both.groupBy("obs").applyInPandas(run, "error double").agg(F.avg("error").alias("loss"))


#: Losses by name: (both, features) to one row.
LOSSES = {
    "mae": mae, "mse": mse, "exp": exp_loss, "coarse_mse": coarse_mse, "spatial_extremes": spatial_extremes, "temporal_extremes": temporal_extremes,
    "spatial_derivative": spatial_derivative, "temporal_derivative": temporal_derivative,
}


def together(both: DataFrame, features: list[str], names: list[str] | None = None) -> DataFrame:
    """(name, loss) of the losses named, or of all in ``LOSSES``, in few passes: errors of values are one aggregation, those of slopes one more.

    ``material_derivative`` may be named too; the first two features are its wind. Others of ``LOSSES``, registered ones too, take a pass each.
    """
    names = list(LOSSES) if names is None else list(names)
    unknown = set(names) - set(LOSSES) - {"material_derivative"}
    if unknown:
        raise ValueError(f"no loss {sorted(unknown)}; known: {sorted(LOSSES)}")
    sloped = {"spatial_derivative": ("south_north", "west_east"), "temporal_derivative": ("t_idx",), "material_derivative": ("t_idx", "south_north", "west_east")}
    frames = []
    points = {x: _mean(features, x) for x in names if x in POINTWISE}
    if points:
        frames.append(both.agg(*[c.alias(x) for x, c in points.items()]))
    slopes = {x: _flow_error(*features[:2]) if x == "material_derivative" else _slope_error(features, sloped[x]) for x in names if x in sloped}
    if slopes:
        axes = tuple(a for a in CELL if any(a in sloped[x] for x in slopes))
        frames.append(_derived(both, features, axes).agg(*[c.alias(x) for x, c in slopes.items()]))
    out = [f.select(F.explode(F.array(*[F.struct(F.lit(x).alias("name"), F.col(x).alias("loss")) for x in f.columns])).alias("x")).select("x.*") for f in frames]
    out += [LOSSES[x](both, features).select(F.lit(x).alias("name"), "loss") for x in names if x not in points and x not in slopes]
    whole = out[0]
    for rest in out[1:]:
        whole = whole.unionByName(rest)
    return whole


def weighted(both: DataFrame, features: list[str], terms: dict[str, float]) -> DataFrame:
    """Weighted sum of losses by name."""
    weight = F.element_at(F.create_map(*[F.lit(x) for name, w in terms.items() for x in (name, float(w))]), F.col("name"))
    return together(both, features, list(terms)).agg(F.sum(F.col("loss") * weight).alias("loss"))
