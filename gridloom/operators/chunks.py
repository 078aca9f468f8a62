"""Chunks of a cube with overlap, for models that see one padded chunk at a time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def slices(size: int, chunk: int) -> list[tuple[int, int]]:
    return [(a, min(a + chunk, size)) for a in range(0, size, chunk)]


@dataclass(frozen=True)
class Layout:
    """How a coarse cube of (rows, columns, steps) is cut: chunk shape, overlap and refinement.

    ``least``: what a padded chunk must measure at least along each axis. A last chunk that is too narrow gets half of it and one more
    as its overlap on both sides, mirrored at the border as any other.
    """

    shape: tuple[int, int, int]
    chunk: tuple[int, int, int]
    pad: tuple[int, int, int] = (0, 0, 0)
    enhance: tuple[int, int, int] = (1, 1, 1)
    least: tuple[int, int, int] = (0, 0, 0)

    def pad_of(self, axis: int, place: int) -> int:
        """The overlap of the chunk at a place along an axis."""
        size, chunk, pad = self.shape[axis], self.chunk[axis], self.pad[axis]
        width = min((place + 1) * chunk, size) - place * chunk
        last = place == -(-size // chunk) - 1
        return self.least[axis] // 2 + 1 if last and width + 2 * pad < self.least[axis] else pad

    def pads(self, chunk_id: int) -> list[int]:
        """The chunk's overlap along each axis."""
        return [self.pad_of(axis, a // c) for axis, ((a, _), c) in enumerate(zip(self.spans(chunk_id), self.chunk, strict=True))]

    def counts(self) -> tuple[int, int, int]:
        """Chunks along each axis."""
        return tuple(-(-n // c) for n, c in zip(self.shape, self.chunk, strict=True))

    def spans(self, chunk_id: int) -> list[tuple[int, int]]:
        """The chunk's own range along each axis, by arithmetic with its id."""
        _, columns, times = self.counts()
        places = (chunk_id // times // columns, chunk_id // times % columns, chunk_id % times)
        return [(k * c, min((k + 1) * c, n)) for k, c, n in zip(places, self.chunk, self.shape, strict=True)]

    def refined(self, s: int, t: int) -> Layout:
        """The same chunks on a grid so many times finer; their ids are the same."""
        return _Refined(self.shape, self.chunk, self.pad, self.enhance, self.least, (s, s, t))

    def flat(self) -> Layout:
        """The spatial chunks alone, of one step."""
        return Layout((*self.shape[:2], 1), (*self.chunk[:2], 1), (*self.pad[:2], 0), least=(*self.least[:2], 0))

    def places(self, axis: int) -> list[tuple[int, int, int]]:
        """(place in the cube, chunk, place in the padded chunk) along an axis, mirrored at the borders."""
        size, out = self.shape[axis], []
        period = 2 * (size - 1) or 1
        for c, (a, b) in enumerate(slices(size, self.chunk[axis])):
            pad = self.pad_of(axis, c)
            for k in range(a - pad, b + pad):
                at = k % period
                out.append((min(at, period - at) if size > 1 else 0, c, k - a + pad))
        return out

    def table(self) -> list[tuple]:
        """One row a chunk: by axis the chunk, its padded range within the cube, what mirroring adds, the fine range and the crop."""
        axes = []
        for axis, (size, chunk, factor) in enumerate(zip(self.shape, self.chunk, self.enhance, strict=True)):
            rows = []
            for place, (a, b) in enumerate(slices(size, chunk)):
                pad = self.pad_of(axis, place)
                lo, hi = max(a - pad, 0), min(b + pad, size)
                before, behind = pad - (a - lo), pad - (hi - b)
                rows.append((a, b, lo, hi, before, behind, a * factor, b * factor, pad * factor, (pad + b - a) * factor))
            axes.append(rows)
        out, spatial = [], 0
        for i in axes[0]:
            for j in axes[1]:
                for t, times in enumerate(axes[2]):
                    out.append((spatial * len(axes[2]) + t, spatial, t, *i, *j, *times))
                spatial += 1
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        names = [f"{axis}_{what}" for axis in "ijt" for what in ("from", "to", "pad_from", "pad_to", "mirror_before", "mirror_behind", "fine_from", "fine_to", "crop_from", "crop_to")]
        return spark.createDataFrame(self.table(), ", ".join(f"{n} int" for n in ("chunk_id", "s_chunk", "t_chunk", *names)))


@dataclass(frozen=True)
class _Refined(Layout):
    """A layout on a grid ``by`` times finer: its places are those of the coarse one, each as many fine ones; mirrors fall on fine cells."""

    by: tuple[int, int, int] = (1, 1, 1)

    def flat(self) -> Layout:
        return _Refined((*self.shape[:2], 1), (*self.chunk[:2], 1), (*self.pad[:2], 0), (1, 1, 1), (*self.least[:2], 0), (*self.by[:2], 1))

    def places(self, axis: int) -> list[tuple[int, int, int]]:
        size, f, out = self.shape[axis] * self.by[axis], self.by[axis], []
        period = 2 * (size - 1) or 1
        for c, (a, b) in enumerate(slices(self.shape[axis], self.chunk[axis])):
            pad = self.pad_of(axis, c)
            for k in range((a - pad) * f, (b + pad) * f):
                at = k % period
                out.append((min(at, period - at) if size > 1 else 0, c, k - (a - pad) * f))
        return out


def with_halo(df: DataFrame, layout: Layout) -> DataFrame:
    """Rows sent to each chunk whose padded range holds them, mirrored at the cube's edges; ``i, j, t`` are places in the padded chunk.

    A row's chunks follow from arithmetic with its place, by a join with one small table an axis.
    """
    spark = df.sparkSession
    for axis, (name, column) in enumerate(zip("ijt", ("south_north", "west_east", "t_idx"), strict=True)):
        table = spark.createDataFrame(layout.places(axis), f"{column} int, {name}_chunk int, {name} int")
        df = df.join(F.broadcast(table), column)
    _, columns, times = layout.counts()
    return df.withColumn("s_chunk", F.col("i_chunk") * columns + F.col("j_chunk")).withColumn("chunk_id", F.col("s_chunk") * times + F.col("t_chunk"))


@dataclass(frozen=True)
class ExoSlice:
    """What one exogenous field adds to one model of a chain in a chunk: (rows, columns) or (rows, columns, steps), as much finer than the input as its step says."""

    feature: str
    model: int
    combine: str
    values: np.ndarray


def exo_rows(exo: list[tuple], layout: Layout) -> DataFrame:
    """(chunk_id, step, i, j, t, value): every exogenous field's cells sent to each chunk whose padded range, refined as the field is, holds them.

    ``exo``: (step, frame) with step's feature, s_enhance and t_enhance and the frame's south_north, west_east, t_idx if it changes in
    time, and the feature. A field that stays goes to every chunk of times with t = -1. Edges are mirrored on the finer grid.
    """
    out = None
    for k, (step, frame) in enumerate(exo):
        fine = layout.refined(step.s_enhance, step.t_enhance)
        value = F.col(step.feature).cast("double").alias("value")
        if "t_idx" in frame.columns:
            rows = with_halo(frame, fine).select("chunk_id", F.lit(k).alias("step"), "i", "j", "t", value)
        else:
            times = layout.counts()[2]
            sent = with_halo(frame.withColumn("t_idx", F.lit(0)), fine.flat())
            every = F.explode(F.transform(F.sequence(F.lit(0), F.lit(times - 1)), lambda t: F.col("s_chunk") * times + t))  # noqa: B023
            rows = sent.select(every.alias("chunk_id"), F.lit(k).alias("step"), "i", "j", F.lit(-1).alias("t"), value)
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("chunk_id", F.col("chunk_id").cast("int"))


def forward_pass(df: DataFrame, features: list[str], layout: Layout, model: Callable, output: list[str], skip: DataFrame | None = None, exo: list[tuple] | None = None) -> DataFrame:
    """Each padded chunk through ``model``, cropped to its own fine cells.

    ``model`` takes an array (rows, columns, steps, features) and returns one refined by
    ``layout.enhance``. With ``exo`` (see :func:`exo_rows`) it takes the chunk's list of :class:`ExoSlice` too, which come
    to it by a cogroup. Chunks in ``skip`` (chunk_id) are left out. A chunk is one group: its size is
    the layout's, whatever the cube's. Cells without a row are NaN.
    """
    sent = with_halo(df, layout).withColumn("chunk_id", F.col("chunk_id").cast("int"))
    if skip is not None:
        sent = sent.join(skip.select("chunk_id"), "chunk_id", "left_anti")
    steps = [step for step, _ in exo or []]
    names = ["chunk_id", "south_north", "west_east", "t_idx", *output]

    def padded(chunk: int, by: tuple[int, ...]) -> list[int]:
        return [(b - a + 2 * p) * f for (a, b), p, f in zip(layout.spans(chunk), layout.pads(chunk), by, strict=False)]

    def run(pdf: pd.DataFrame, extra: pd.DataFrame | None = None) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=names)
        chunk = int(pdf["chunk_id"].iloc[0])
        spans = layout.spans(chunk)
        cube = np.full((*padded(chunk, (1, 1, 1)), len(features)), np.nan)
        cube[pdf["i"], pdf["j"], pdf["t"]] = pdf[features].to_numpy()
        fine = model(cube) if extra is None else model(cube, slices_of(chunk, extra))
        crop = [slice(p * f, (p + b - a) * f) for (a, b), p, f in zip(spans, layout.pads(chunk), layout.enhance, strict=True)]
        cut = fine[tuple(crop)]
        at = np.meshgrid(*[np.arange(a * f, b * f, dtype=np.int32) for (a, b), f in zip(spans, layout.enhance, strict=True)], indexing="ij")
        if cut.shape[:3] != at[0].shape or cut.shape[3] != len(output):
            raise ValueError(f"the model gave {fine.shape} for {cube.shape}, refined by {layout.enhance} with {len(output)} outputs")
        out = {"chunk_id": np.int32(chunk), **{c: x.ravel() for c, x in zip(names[1:4], at, strict=True)}}
        return pd.DataFrame({**out, **{o: cut[..., k].ravel() for k, o in enumerate(output)}})

    def slices_of(chunk: int, extra: pd.DataFrame) -> list[ExoSlice]:
        out = []
        for k, step in enumerate(steps):
            mine = extra[extra["step"] == k]
            moving = bool(len(mine)) and int(mine["t"].iloc[0]) >= 0
            values = np.full(padded(chunk, (step.s_enhance, step.s_enhance, step.t_enhance) if moving else (step.s_enhance, step.s_enhance)), np.nan)
            values[tuple(mine[c] for c in ("i", "j", "t")[: values.ndim])] = mine["value"].to_numpy()
            out.append(ExoSlice(step.feature, step.model, step.combine, values))
        return out

    schema = "chunk_id int, south_north int, west_east int, t_idx int, " + ", ".join(f"`{o}` double" for o in output)
    if not exo:
        return sent.groupBy("chunk_id").applyInPandas(lambda pdf: run(pdf), schema)
    sides = sent.groupBy("chunk_id").cogroup(exo_rows(exo, layout).groupBy("chunk_id"))
    return sides.applyInPandas(lambda pdf, extra: run(pdf, extra), schema)
