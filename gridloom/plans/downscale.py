"""Inference over a domain: correct, cut into padded chunks, run the model, stitch, check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import enforce
from ..operators import bias, chunks, collect, grid, raster
from ..operators.models import chain_of
from ..operators.windows import fill_nearest
from . import pairs


@dataclass
class Downscaling:
    """A model over chunks of a layout; ``limits`` holds outputs to their ranges, ``wind`` names u/v pairs to turn into speed and direction."""

    model: Callable
    layout: chunks.Layout
    inputs: list[str]
    outputs: list[str]
    correction: tuple[str, DataFrame, list[str]] | None = None
    mask: DataFrame | None = None  # (south_north, west_east, mask): chunks masked throughout are left out
    limits: bool = True
    fill: bool = False
    wind: list[tuple[str, str]] = field(default_factory=list)
    exo: list[tuple] = field(default_factory=list)  # (ExoStep, field on its grid), see chunks.exo_rows

    def skipped(self, written: DataFrame | None) -> DataFrame | None:
        """Chunks that are masked throughout, padding included, or already written."""
        out = None
        if self.mask is not None:
            masked = raster.masked_chunks(chunks.with_halo(self.mask.withColumn("t_idx", F.lit(0)), self.layout.flat()))
            count = self.layout.counts()[2]
            out = masked.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda t: F.col("s_chunk") * count + t)).alias("chunk_id"))
        if written is not None:
            done = written.select("chunk_id").distinct()
            out = done if out is None else out.unionByName(done).distinct()
        return out

    def run(self, df: DataFrame, written: DataFrame | None = None) -> DataFrame:
        """(chunk_id, south_north, west_east, t_idx, outputs) on the fine grid."""
        if self.correction:
            method, factors, features = self.correction
            df = bias.correct(df, method, factors, features)
        raster.require_features(df, self.inputs)
        out = chunks.forward_pass(df, self.inputs, self.layout, self.model, self.outputs, self.skipped(written), self.exo)
        if self.limits:
            out = out.withColumns({f: enforce(f, F.col(f), self.fill) for f in self.outputs})
            if self.fill:
                for f in self.outputs:
                    out = fill_nearest(out, f, ("t_idx",))
        return collect.to_speed_direction(out, self.wind) if self.wind else out

    def place(self, out: DataFrame, coarse_grid: DataFrame) -> DataFrame:
        """The output with gid, latitude and longitude of the fine grid."""
        rows, columns, _ = self.layout.shape
        s = self.layout.enhance[0]
        return grid.flatten(out.join(grid.fine_coordinates(coarse_grid, rows, columns, s), ["south_north", "west_east"]), columns * s)


def configured(
    df: DataFrame, models: list[dict], chunk: tuple[int, int, int], pad: tuple[int, int, int] = (0, 0, 0), exogenous: dict[str, dict] | None = None, sources: dict[str, DataFrame] | None = None, **options
) -> tuple[Downscaling, DataFrame]:
    """A downscaling from plain configurations, and its cube with numbered steps.

    ``df``: a full cube (south_north, west_east, latitude, longitude, time, features). ``models``: see :func:`models.chain_of`. ``exogenous``:
    by feature {"steps": [[model, combine], ...], "bound": degrees, "scale": 1}; ``sources``: by feature the points (gid, latitude, longitude, the feature)
    whose means fill the field at every step's resolution.
    """
    cube = raster.time_index(df)
    top = cube.agg(*[(F.max(c) + 1).alias(c) for c in ("south_north", "west_east", "t_idx")]).first()
    shape = (int(top["south_north"]), int(top["west_east"]), int(top["t_idx"]))
    steps, by_model = [], [(m.get("s_enhance", 1), m.get("t_enhance", 1)) for m in models]
    for feature, wanted in (exogenous or {}).items():
        steps += pairs.exo_steps(feature, [tuple(s) for s in wanted["steps"]], [s for s, _ in by_model], [t for _, t in by_model])
    chain = chain_of(models, steps)
    places = cube.select("south_north", "west_east", "latitude", "longitude").distinct()
    fields = []
    for step in steps:
        wanted = exogenous[step.feature]
        fine = places if step.s_enhance == 1 else grid.fine_coordinates(places, shape[0], shape[1], step.s_enhance)
        target = fine.withColumn("gid", (F.col("south_north") * (shape[1] * step.s_enhance) + F.col("west_east")).cast("long"))
        field_ = pairs.exo_field(sources[step.feature], target, step.feature, wanted["bound"], wanted.get("scale", 1.0))
        fields.append((step, field_.select("south_north", "west_east", step.feature)))
    layout = chunks.Layout(shape, tuple(chunk), tuple(pad), (chain.s_enhance, chain.s_enhance, chain.t_enhance))
    return Downscaling(chain, layout, chain.inputs, chain.outputs, exo=fields, **options), cube
