"""Neighbourhood operations along time and over the grid."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SERIES = ("south_north", "west_east")


def roll(df: DataFrame, features: list[str], n: int, length: int, by: tuple[str, ...] = SERIES) -> DataFrame:
    """Values moved ``n`` places on along ``t_idx``, around the end; the index stays."""
    moved = df.select(*by, F.pmod(F.col("t_idx") + n, F.lit(length)).alias("t_idx"), *features)
    return df.drop(*features).join(moved, [*by, "t_idx"], "left")


def shift_time(df: DataFrame, minutes: int, time: str = "time") -> DataFrame:
    return df.withColumn(time, F.col(time) + F.make_dt_interval(mins=F.lit(minutes)))


def roll_to_utc(df: DataFrame, feature: str, timezone: int, length: int, by: tuple[str, ...] = SERIES) -> DataFrame:
    """Local time to UTC west of Greenwich: moved by -timezone; the first hours take the first moved value."""
    rolled = roll(df, [feature], -timezone, length, by)
    first = F.max(F.when(F.col("t_idx") == -timezone, F.col(feature))).over(Window.partitionBy(*by))
    return rolled.withColumn(feature, F.when(F.col("t_idx") < -timezone, first).otherwise(F.col(feature)))


def difference(df: DataFrame, feature: str, along: str, by: tuple[str, ...], n: int = 1, period: float | None = None) -> DataFrame:
    """x minus the one ``n`` before it; with a period, the nearest of the equivalent differences."""
    step = F.col(feature) - F.lag(feature, n).over(Window.partitionBy(*by).orderBy(along))
    if period:
        step = F.pmod(step + period / 2, F.lit(period)) - period / 2
    return df.withColumn(f"{feature}_diff", step)


def derivative(df: DataFrame, feature: str, along: str, by: tuple[str, ...]) -> DataFrame:
    """Central difference, one-sided at the edges."""
    w = Window.partitionBy(*by).orderBy(along)
    before, after = F.lag(feature).over(w), F.lead(feature).over(w)
    first, last = F.lag(along).over(w).isNull(), F.lead(along).over(w).isNull()
    x = F.col(feature)
    return df.withColumn(f"{feature}_d_{along}", F.when(first, after - x).when(last, x - before).otherwise((after - before) / 2))


def rotation(grid: DataFrame) -> DataFrame:
    """``theta``: angle of the grid's columns from north at each cell; the northernmost row has the second's.

    Rows whose latitudes rise are taken from the last to the first.
    """
    w = Window.partitionBy("west_east").orderBy("south_north")
    ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rising = F.last("latitude").over(ends) > F.first("latitude").over(ends)
    before = lambda c: F.when(F.col("_rising"), F.lead(c).over(w)).otherwise(F.lag(c).over(w))
    wrap = lambda x, half: F.pmod(x + half, F.lit(2.0 * half)) - half
    dy = wrap(F.col("latitude") - before("latitude"), 90.0)
    dx = wrap(F.col("longitude") - before("longitude"), 180.0)
    angled = grid.withColumn("_rising", rising).withColumn("theta", math.pi / 2 - F.atan2(dy, dx))
    following = F.when(F.col("_rising"), F.lag("theta").over(w)).otherwise(F.lead("theta").over(w))
    return angled.withColumn("theta", F.coalesce("theta", following, F.lit(0.0))).drop("_rising")


def interpolate_na(df: DataFrame, feature: str, along: str = "t_idx", by: tuple[str, ...] = SERIES, method: str = "linear") -> DataFrame:
    """Nulls of a series from its values before and behind; the ends go on from the two nearest values (linear) or repeat one (nearest)."""
    # ``ahead`` runs from the last row: a frame that reaches to a window's end is computed anew for each row
    back, ahead = (Window.partitionBy(*by).orderBy(order(along)).rowsBetween(Window.unboundedPreceding, -1) for order in (F.asc, F.desc))
    here = F.when(F.col(feature).isNotNull(), F.struct(F.col(along).alias("t"), F.col(feature).alias("x")))
    marked = df.withColumn("_here", here)
    previous, following = F.last("_here", True).over(back), F.last("_here", True).over(ahead)
    marked = marked.withColumns({"_p": previous, "_n": following})
    marked = marked.withColumn("_pp", F.last(F.when(F.col("_here").isNotNull(), F.struct(F.col("_here").alias("a"), F.col("_p").alias("b"))), True).over(back))
    marked = marked.withColumn("_nn", F.last(F.when(F.col("_here").isNotNull(), F.struct(F.col("_here").alias("a"), F.col("_n").alias("b"))), True).over(ahead))
    t = F.col(along)
    line = lambda a, b: a["x"] + (t - a["t"]) * F.try_divide(b["x"] - a["x"], b["t"] - a["t"])
    if method == "nearest":
        filled = F.when(F.col("_n").isNull() | (t - F.col("_p.t") <= F.col("_n.t") - t), F.col("_p.x")).otherwise(F.col("_n.x"))
    else:
        behind = F.coalesce(line(F.col("_pp.b"), F.col("_pp.a")), F.col("_p.x"))
        before = F.coalesce(line(F.col("_nn.a"), F.col("_nn.b")), F.col("_n.x"))
        filled = F.when(F.col("_n").isNull(), behind).when(F.col("_p").isNull(), before).otherwise(line(F.col("_p"), F.col("_n")))
    return marked.withColumn(feature, F.coalesce(F.col(feature), filled)).drop("_here", "_p", "_n", "_pp", "_nn")


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    reach = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    return [(k, w / sum(raw)) for k, w in zip(range(-reach, reach + 1), raw, strict=True)]


def smooth(df: DataFrame, feature: str, sigma: float, rows: int, columns: int, by: tuple[str, ...] = ("time",)) -> DataFrame:
    """Gaussian smoothing of fields, edges repeated: the kernel falls into one pass along each axis.

    A pass sends each value to the places it counts for (clamped at the edges) and sums by place.
    """
    if not sigma:
        return df
    for axis, size in (("south_north", rows), ("west_east", columns)):
        other = "west_east" if axis == "south_north" else "south_north"
        inside = [F.struct((F.col(axis) - k).alias(axis), F.lit(w).alias("w")) for k, w in gaussian_weights(sigma)]
        reach = len(inside) // 2
        # a place whose kernel leaves the field takes the edge's value for all that is outside
        edges = [F.when(F.col(axis) == edge, _at_edge(axis, edge, min(reach, size), sigma)) for edge in (0, size - 1)]
        sent = F.concat(F.array(*inside), *[F.coalesce(e, F.array().cast(f"array<struct<{axis}:int,w:double>>")) for e in edges])
        spread = df.select(*by, other, F.col(feature), F.explode(F.filter(sent, _inside(axis, size))).alias("s"))
        df = spread.groupBy(*by, other, F.col(f"s.{axis}").alias(axis)).agg(F.sum(F.col(feature) * F.col("s.w")).alias(feature))
    return df


def _at_edge(axis: str, edge: int, reach: int, sigma: float) -> Column:
    place = lambda d: (d if edge == 0 else F.lit(edge) - d).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(reach - 1)), lambda d: F.struct(place(d).alias(axis), _outside(d, sigma).alias("w")))


def _inside(axis: str, size: int):
    return lambda s: (s[axis] >= 0) & (s[axis] < size)


def _outside(d: Column, sigma: float) -> Column:
    """Weight of all kernel places more than ``d`` away on one side."""
    weights = dict(gaussian_weights(sigma))
    reach = max(weights)
    tails = [sum(weights[k] for k in range(j + 1, reach + 1)) for j in range(reach)] or [0.0]
    return F.coalesce(F.get(F.array(*[F.lit(t) for t in tails]), d), F.lit(0.0))


#: Rows of a field that one group of the second pass takes, and cells of a field at most (squared distances times places in 63 bits).
FILL_ROWS, MOST_CELLS = 32, 1_600_000_000


def nearest_columns(cost: np.ndarray, none: int, weight: int) -> np.ndarray:
    """By row and column x the column q with the least weight (x - q)^2 + cost[row, q], -1 in a row of ``none`` alone; costs differ.

    The lower envelope of a row's parabolas, built from left to right; all rows at once, each in steps linear in its columns.
    """
    rows, columns = cost.shape
    every = np.arange(rows)
    owner = np.full((rows, columns), -1, np.int64)  # parabolas of the envelope so far, from left to right
    start = np.zeros((rows, columns), np.int64)  # where each begins to be the least
    top = np.full(rows, -1)
    for q in range(columns):
        open_ = cost[:, q] < none
        first = np.zeros(rows, np.int64)
        turn = every[open_ & (top >= 0)]
        while len(turn):
            v = owner[turn, top[turn]]
            apart = (cost[turn, q] + weight * q * q) - (cost[turn, v] + weight * v * v)
            first[turn] = apart // (2 * weight * (q - v)) + 1
            hidden = first[turn] <= start[turn, top[turn]]
            top[turn[hidden]] -= 1
            first[turn[hidden]] = 0
            turn = turn[hidden]
            turn = turn[top[turn] >= 0]
        top[open_] += 1
        owner[every[open_], top[open_]] = q
        start[every[open_], top[open_]] = np.where(top[open_] == 0, 0, first[open_])
    place = np.zeros((rows, columns), np.int64)
    at, kth = np.nonzero(np.arange(columns)[None, :] <= top[:, None])
    inside = start[at, kth] < columns
    np.maximum.at(place, (at[inside], np.maximum(start[at, kth][inside], 0)), kth[inside])
    return owner[every[:, None], np.maximum.accumulate(place, axis=1)]


def fill_nearest(df: DataFrame, feature: str, by: tuple[str, ...] = ("time",)) -> DataFrame:
    """Nulls of each field from the nearest cell that has a value (index distance; least row, then column, on a tie).

    An exact distance transform in two passes. Along each column two windows find the nearest value above and below every
    row with gaps; along each row the lower envelope of the columns' parabolas tells the nearest of them. Both are linear in the cells of a
    field, however far its values are apart. Fields without any value stay null; places are not negative.
    """
    filled = df.where(F.col(feature).isNotNull()).select(*by, F.col("west_east").alias("_j"), F.col("south_north").alias("_i"), F.col(feature).alias("_v"))
    empty = df.where(F.col(feature).isNull()).select(*by, *SERIES)
    needed = empty.select(*by, F.col("south_north").alias("_i")).distinct().join(filled.select(*by, "_j").distinct(), list(by))
    source = F.struct(F.col("_i").alias("row"), F.col("_v").alias("value"))
    kind = dict(filled.select(source.alias("s")).dtypes)["s"]
    both = filled.select(*by, "_j", "_i", source.alias("_s")).unionByName(needed.select(*by, "_j", "_i", F.lit(None).cast(kind).alias("_s")))
    # both frames grow from the window's first row: one that reaches to the last is computed anew for each row
    down, up = (Window.partitionBy(*by, "_j").orderBy(order("_i"), F.col("_s").isNull()) for order in (F.asc, F.desc))
    above, below = (F.last("_s", True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for w in (down, up))
    nearer = F.when(F.col("_a").isNull() | (F.col("_b.row") - F.col("_i") < F.col("_i") - F.col("_a.row")), F.col("_b")).otherwise(F.col("_a"))
    found = both.withColumns({"_a": above, "_b": below}).where("_s is null").select(*by, "_j", "_i", nearer.alias("_n"))
    found = found.select(*by, "_i", "_j", F.col("_n.row").cast("long").alias("_row"), F.col("_n.value").alias("_v"))
    gaps = empty.select(*by, F.col("south_north").alias("_i"), F.col("west_east").alias("_j"), F.lit(None).cast("long").alias("_row"), F.lit(None).cast(df.schema[feature].dataType).alias("_v"))
    types = {f.name: f.dataType for f in df.schema}
    schema = T.StructType([T.StructField(c, types[c]) for c in (*by, *SERIES)] + [T.StructField("_best", types[feature])])

    def envelope(pdf: pd.DataFrame) -> pd.DataFrame:
        known, asked = pdf[pdf["_row"].notna()], pdf[pdf["_row"].isna()]
        names = [*by, *SERIES, "_best"]
        if not len(known) or not len(asked):
            return pd.DataFrame(columns=names)
        width = int(pdf["_j"].max()) + 1
        weight = (int(known["_row"].max()) + 1) * width
        if weight > MOST_CELLS:
            raise ValueError(f"a field of {weight} cells; {MOST_CELLS} at most")
        low = int(pdf["_i"].min())
        height = int(pdf["_i"].max()) - low + 1
        none = np.iinfo(np.int64).max // 4
        cost = np.full((height, width), none)
        at = np.full((height, width), -1)
        i, j, row = (known[c].to_numpy().astype(np.int64) for c in ("_i", "_j", "_row"))
        cost[i - low, j] = weight * (row - i) ** 2 + row * width + j  # ties by row, then column
        at[i - low, j] = np.arange(len(known))
        x, y = asked["_i"].to_numpy().astype(np.int64) - low, asked["_j"].to_numpy().astype(np.int64)
        q = nearest_columns(cost, none, weight)[x, y]
        out = asked[[*by, "_i", "_j"]].set_axis(names[:-1], axis=1)[q >= 0]
        return out.assign(_best=known["_v"].to_numpy()[at[x, q][q >= 0]])

    # a block's rows come together under one key of all its parts
    block = F.floor(F.col("_i") / FILL_ROWS).alias("_block")
    best = found.unionByName(gaps).withColumn("_block", block).groupBy(*by, "_block").applyInPandas(envelope, schema)
    return df.join(best, [*by, *SERIES], "left").withColumn(feature, F.coalesce(F.col(feature), F.col("_best"))).drop("_best")


def reflect_index(position: Column, length: int) -> Column:
    """The place that a place outside [0, length) mirrors, the edge itself not repeated."""
    if length == 1:
        return F.lit(0)
    period = 2 * (length - 1)
    at = F.pmod(position, F.lit(period))
    return F.least(at, period - at).cast("int")


def pad_reflect(df: DataFrame, axis: str, length: int, before: int, behind: int) -> DataFrame:
    """The field with mirrored cells before and behind it along an axis; places run from -before."""
    places = df.sparkSession.range(-before, length + behind).select(F.col("id").cast("int").alias("_at"))
    return df.join(F.broadcast(places.withColumn(axis, reflect_index(F.col("_at"), length))), axis).drop(axis).withColumnRenamed("_at", axis)


def running_mean(df: DataFrame, value: str, order: str, n: int, by: tuple[str, ...]) -> DataFrame:
    return df.withColumn(f"{value}_mean", F.avg(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-(n - 1), 0)))


def early_stop(history: DataFrame, value: str, order: str, n: int, threshold: float, by: tuple[str, ...]) -> DataFrame:
    """Whether the last ``n`` absolute changes are all below the threshold."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    changed = history.withColumn("_d", F.abs(F.col(value) - F.lead(value).over(w))).withColumn("_r", F.row_number().over(w))
    return changed.where(F.col("_r") <= n).groupBy(*by).agg((F.bool_and(F.coalesce(F.col("_d") < threshold, F.lit(False))) & (F.count("_d") == n)).alias("stop"))


def daylight(df: DataFrame, ratio: str = "clearsky_ratio") -> DataFrame:
    """(date, first, last): the hours of each day that have any value."""
    hours = df.where(F.col(ratio).isNotNull()).select(F.to_date("time").alias("date"), F.hour("time").alias("hour"))
    return hours.groupBy("date").agg(F.min("hour").alias("first"), F.max("hour").alias("last"))


def combine(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
