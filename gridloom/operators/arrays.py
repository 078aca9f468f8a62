"""One group of rows as an array, inside a task."""

from __future__ import annotations

import numpy as np
import pandas as pd


def dense(pdf: pd.DataFrame, axes: list[str], column: str, missing: float = 0.0) -> np.ndarray:
    """The column by its places along the axes that occur; places without a row, and nulls, are ``missing``."""
    places = [np.unique(pdf[a].to_numpy(), return_inverse=True) for a in axes]
    out = np.full([len(values) for values, _ in places], missing)
    out[tuple(at for _, at in places)] = pdf[column].fillna(missing).to_numpy()
    return out
