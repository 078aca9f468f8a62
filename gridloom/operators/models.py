"""Downscaling models in closed form, and the contract for others.

A model is any callable from an array (rows, columns, steps, features) to a finer one;
:func:`gridloom.operators.chunks.forward_pass` runs it by chunk.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np

from ..functions.scalars import LAPSE_C_PER_KM, PRESSURE_POWER, SCALE_HEIGHT_M, SEA_LEVEL_PA


class Model(Protocol):
    s_enhance: int
    t_enhance: int

    def __call__(self, cube: np.ndarray) -> np.ndarray: ...


def _line(n: int, factor: int, centered: bool) -> tuple[np.ndarray, np.ndarray]:
    at = (np.arange(n * factor) + 0.5) / factor - 0.5 if centered else np.arange(n * factor) / factor
    low = np.clip(np.floor(at).astype(int), 0, max(n - 2, 0))
    return low, at - low


class LinearModel:
    """Linear refinement in space and time; lines go on beyond the ends."""

    def __init__(self, s_enhance: int, t_enhance: int, t_centered: bool = False):
        self.s_enhance, self.t_enhance, self.t_centered = s_enhance, t_enhance, t_centered

    def __call__(self, cube: np.ndarray) -> np.ndarray:
        for axis, factor, centered in ((0, self.s_enhance, True), (1, self.s_enhance, True), (2, self.t_enhance, self.t_centered)):
            n = cube.shape[axis]
            if factor == 1:
                continue
            if n == 1:
                cube = np.repeat(cube, factor, axis)
                continue
            low, share = _line(n, factor, centered)
            share = share.reshape([-1 if a == axis else 1 for a in range(cube.ndim)])
            cube = np.take(cube, low, axis) * (1 - share) + np.take(cube, low + 1, axis) * share
        return cube


def _lanczos(n: int, factor: int, lobes: int = 3) -> np.ndarray:
    """Weights (n * factor, n) of a Lanczos resize; rows sum to one."""
    at = (np.arange(n * factor) + 0.5) / factor - 0.5
    x = at[:, None] - np.arange(n)[None, :]
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return w / w.sum(axis=1, keepdims=True)


class SurfaceModel:
    """Temperature by lapse rate, humidity by temperature and height, pressure by height, anything else resized alone.

    ``coarse`` and ``fine`` are topographies (rows, columns). With ``fix_bias`` each coarse
    cell's mean is kept. ``noise`` (one number, or one a feature, None for none) adds uniform noise from 0 to that; it follows
    from ``seed`` and the chunk's values, so a chunk that is computed again gets the same.
    """

    def __init__(self, features: list[str], coarse: np.ndarray, fine: np.ndarray, weights: tuple[float, float] = (0.0, 0.0), fix_bias: bool = True, noise: float | list[float | None] | None = None, seed: int = 42):
        self.features, self.coarse, self.fine, self.weights, self.fix_bias = features, coarse, fine, weights, fix_bias
        self.noise, self.seed = noise if isinstance(noise, (list, tuple)) else [noise] * len(features), seed
        if len(self.noise) != len(features):
            raise ValueError(f"{len(self.noise)} noises for {len(features)} features")
        self.s_enhance, self.t_enhance = fine.shape[0] // coarse.shape[0], 1

    def _resize(self, field: np.ndarray) -> np.ndarray:
        a, b = (_lanczos(n, self.s_enhance) for n in field.shape[:2])
        return np.einsum("xi,ij...,yj->xy...", a, field, b)

    def _mean(self, fine: np.ndarray) -> np.ndarray:
        s = self.s_enhance
        return fine.reshape(fine.shape[0] // s, s, fine.shape[1] // s, s, *fine.shape[2:]).mean(axis=(1, 3))

    def __call__(self, cube: np.ndarray) -> np.ndarray:
        rise = (self.fine - self._resize(self.coarse))[:, :, None]
        drop = lambda h: SEA_LEVEL_PA * (1 - np.power(1 - h / SCALE_HEIGHT_M, PRESSURE_POWER))
        out, warmer = [], 0.0
        for k, name in enumerate(self.features):
            fine = self._resize(cube[..., k])
            if name.startswith("temperature"):
                warmer = -rise * LAPSE_C_PER_KM / 1000
                fine = fine + warmer
            elif name.startswith("relativehumidity"):
                fine = np.clip(fine + self.weights[0] * warmer + self.weights[1] * rise, 0, 100)
            elif name.startswith("pressure"):
                fine = self._resize(cube[..., k] + drop(self.coarse)[:, :, None]) - drop(self.fine)[:, :, None]
            if self.fix_bias:
                fine = fine + np.repeat(np.repeat(cube[..., k] - self._mean(fine), self.s_enhance, 0), self.s_enhance, 1)
            out.append(fine)
        rng = np.random.default_rng([self.seed, zlib.crc32(np.ascontiguousarray(cube, np.float64).tobytes())])
        return np.stack([fine if most is None else fine + rng.uniform(0, most, fine.shape) for fine, most in zip(out, self.noise, strict=True)], -1)


class WholeDays:
    """A model that gives fewer steps than ``t_enhance`` a coarse one, such as hours of whole days without the outer ones: the lacking ones are mirrored on.

    Both ends get the same number of steps, the end itself not repeated. Steps that cannot be shared out evenly, more than were given and
    more to mirror than there are raise.
    """

    def __init__(self, model: Callable, t_enhance: int = 24, s_enhance: int | None = None):
        self.model, self.t_enhance = model, t_enhance
        self.s_enhance = s_enhance or getattr(model, "s_enhance", 1)

    def __call__(self, cube: np.ndarray, **layers) -> np.ndarray:
        fine = self.model(cube, **layers)
        pad, odd = divmod(cube.shape[2] * self.t_enhance - fine.shape[2], 2)
        if odd or pad < 0 or pad >= max(fine.shape[2], 1):
            raise ValueError(f"{fine.shape[2]} steps cannot be mirrored to {cube.shape[2] * self.t_enhance}")
        return np.pad(fine, [(pad if axis == 2 else 0,) * 2 for axis in range(fine.ndim)], mode="reflect")


def in_sequence(*models: Callable) -> Callable:
    """One model after the other."""

    def run(cube: np.ndarray) -> np.ndarray:
        for m in models:
            cube = m(cube)
        return cube

    return run


@dataclass(frozen=True)
class Step:
    """One model of a chain: which features it takes and gives, in order, and how much finer it makes them.

    A ``spatial`` one sees (steps, rows, columns, features), each step alone; others (rows, columns, steps, features).
    """

    model: Callable
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    s_enhance: int = 1
    t_enhance: int = 1
    spatial: bool = False


class Chain:
    """Models one after the other, features matched by name, exogenous fields put in where they belong.

    What a step takes comes from the step before or from an exogenous field combined as ``input`` (at the step's input
    resolution). Fields combined as ``layer`` (at its output resolution) go to the model as ``layers``, {feature: array}; those combined
    as ``output`` join its outputs. A feature that nothing gives raises, as does an output of a wrong shape.
    """

    def __init__(self, steps: list[Step], inputs: list[str] | None = None, exo: list | None = None):
        self.steps, self.exo = list(steps), [(e.feature, e.model, e.combine) for e in exo or []]
        given = lambda k, how: {f for f, m, c in self.exo if m == k and c == how}
        self.inputs = list(inputs) if inputs is not None else [f for f in steps[0].inputs if f not in given(0, "input")]
        self.s_enhance, self.t_enhance = math.prod(s.s_enhance for s in steps), math.prod(s.t_enhance for s in steps)
        have = set(self.inputs)
        for k, step in enumerate(self.steps):
            lacking = set(step.inputs) - have - given(k, "input")
            if lacking:
                raise ValueError(f"nothing gives {sorted(lacking)} to model {k}")
            have = set(step.outputs) | given(k, "output")
        self.outputs = [*self.steps[-1].outputs, *sorted(given(len(self.steps) - 1, "output"))]

    def __call__(self, cube: np.ndarray, exo: list = ()) -> np.ndarray:
        have = {f: cube[..., k] for k, f in enumerate(self.inputs)}
        shape = cube.shape[:3]
        for k, step in enumerate(self.steps):
            fine = (shape[0] * step.s_enhance, shape[1] * step.s_enhance, shape[2] * step.t_enhance)
            mine = {how: {e.feature: e.values for e in exo if e.model == k and e.combine == how} for how in ("input", "layer", "output")}
            have |= {f: _over(f, v, shape) for f, v in mine["input"].items()}
            x = np.stack([have[f] for f in step.inputs], -1)
            layers = {f: _over(f, v, fine) for f, v in mine["layer"].items()}
            if step.spatial:
                x, layers = np.moveaxis(x, 2, 0), {f: np.moveaxis(v, 2, 0) for f, v in layers.items()}
            y = step.model(x, layers=layers) if layers else step.model(x)
            y = np.moveaxis(y, 0, 2) if step.spatial else y
            if y.shape != (*fine, len(step.outputs)):
                raise ValueError(f"model {k} gave {y.shape}, not {(*fine, len(step.outputs))}")
            have = {f: y[..., n] for n, f in enumerate(step.outputs)} | {f: _over(f, v, fine) for f, v in mine["output"].items()}
            shape = fine
        return np.stack([have[f] for f in self.outputs], -1)


def _over(feature: str, values: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """A field over all steps of ``shape``; one of another resolution raises."""
    values = values[..., None] if values.ndim == 2 else values
    if values.shape[:2] != shape[:2] or values.shape[2] not in (1, shape[2]):
        raise ValueError(f"{feature} is {values.shape} where {shape} is due")
    return np.broadcast_to(values, shape)


#: Model classes by name, for configurations.
MODELS: dict[str, Callable] = {"linear": LinearModel, "surface": SurfaceModel}


def register_model(name: str, build: Callable) -> None:
    """Give a model a name: ``build`` makes it from a configuration's options."""
    MODELS[name] = build


def model_by_name(name: str, **options) -> Callable:
    if name not in MODELS:
        raise ValueError(f"no model {name!r}; known: {sorted(MODELS)}")
    return MODELS[name](**options)


def chain_of(configs: list[dict], exo: list | None = None) -> Chain:
    """A chain from configurations {model, inputs, outputs, spatial, ...options}; s_enhance and t_enhance are options of models that have them."""
    steps = []
    for c in configs:
        rest = {k: v for k, v in c.items() if k not in ("model", "inputs", "outputs", "spatial")}
        model = model_by_name(c["model"], **rest)
        steps.append(Step(model, tuple(c["inputs"]), tuple(c.get("outputs", c["inputs"])), getattr(model, "s_enhance", 1), getattr(model, "t_enhance", 1), c.get("spatial", False)))
    return Chain(steps, exo=exo)
