"""Interpolation between two levels of a profile."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear(l1: Column, l2: Column, v1: Column, v2: Column, level: float) -> Column:
    """Straight line through two samples; the first where their levels coincide."""
    gap = l2 - l1
    alpha = F.when(F.abs(gap) < 1e-3, 0.0).otherwise(F.try_divide(F.lit(float(level)) - l1, gap))
    return v1 * (1 - alpha) + v2 * alpha


def logarithmic(l1: Column, l2: Column, v1: Column, v2: Column, level: float) -> Column:
    """Logarithm of the distance from the lower sample; mirrored below it."""
    low_first = l1 < l2
    h0, h1 = F.least(l1, l2), F.greatest(l1, l2)
    v0, w = F.when(low_first, v1).otherwise(v2), F.when(low_first, v2).otherwise(v1)
    slope = F.when(h1 == h0, 0.0).otherwise(F.try_divide(w - v0, F.log(h1 - h0 + 1)))
    sign = F.when(F.lit(float(level)) < h0, -1.0).otherwise(1.0)
    return sign * slope * F.log(F.abs(F.lit(float(level)) - h0) + 1) + v0


METHODS = {"linear": linear, "log": logarithmic}
