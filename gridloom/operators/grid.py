"""Grid arithmetic, refinement and output coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import cut


def flatten(df: DataFrame, columns: int) -> DataFrame:
    return df.withColumn("gid", (F.col("south_north") * columns + F.col("west_east")).cast("long"))


def unflatten(df: DataFrame, columns: int) -> DataFrame:
    return df.withColumns({"south_north": F.floor(F.col("gid") / columns).cast("int"), "west_east": F.pmod("gid", F.lit(columns)).cast("int")})


def describe(grid: DataFrame) -> DataFrame:
    """(rows, columns, target_lat, target_lon): shape and the lower left cell's coordinates."""
    last = F.max_by(F.struct("latitude", "longitude"), F.struct("south_north", (-F.col("west_east")).alias("w")))
    one = grid.agg((F.max("south_north") + 1).alias("rows"), (F.max("west_east") + 1).alias("columns"), last.alias("t"))
    return one.select("rows", "columns", F.col("t.latitude").alias("target_lat"), F.col("t.longitude").alias("target_lon"))


def is_regular(grid: DataFrame) -> DataFrame:
    """(regular): each row has one latitude and each column one longitude."""
    rows = grid.groupBy("south_north").agg(F.count_distinct("latitude").alias("n"))
    columns = grid.groupBy("west_east").agg(F.count_distinct("longitude").alias("n"))
    return rows.unionByName(columns.withColumnRenamed("west_east", "south_north")).agg((F.max("n") == 1).alias("regular"))


def rising_longitudes(grid: DataFrame) -> DataFrame:
    """Longitudes of rows that fall somewhere from west to east put on 0 to 360."""
    w = Window.partitionBy("south_north").orderBy("west_east")
    falls = grid.withColumn("_f", F.col("longitude") < F.lag("longitude").over(w)).groupBy("south_north").agg(F.coalesce(F.bool_or("_f"), F.lit(False)).alias("_f"))
    any_falls = falls.agg(F.bool_or("_f").alias("_f"))
    return grid.crossJoin(F.broadcast(any_falls)).withColumn("longitude", F.when(F.col("_f"), F.pmod("longitude", F.lit(360.0))).otherwise(F.col("longitude"))).drop("_f")


def repeat_cells(df: DataFrame, s: int) -> DataFrame:
    """Each cell as s by s cells of the same values."""
    inside = F.sequence(F.lit(0), F.lit(s - 1))
    out = df.withColumn("_a", F.explode(inside)).withColumn("_b", F.explode(inside))
    return out.withColumns({"south_north": F.col("south_north") * s + F.col("_a"), "west_east": F.col("west_east") * s + F.col("_b")}).drop("_a", "_b")


def refine_time(df: DataFrame, features: list[str], t: int, linear: bool = True, by: tuple[str, ...] = ("south_north", "west_east")) -> DataFrame:
    """Each step as ``t`` steps: constant, or on the line to the next one (the last goes on as before)."""
    w = Window.partitionBy(*by).orderBy("t_idx")
    slopes = df
    for f in features:
        ahead, behind = F.lead(f).over(w) - F.col(f), F.col(f) - F.lag(f).over(w)
        last = F.lead("t_idx").over(w).isNull()
        slopes = slopes.withColumn(f"_{f}", F.when(last, F.coalesce(behind, F.lit(0.0))).otherwise(ahead) if linear else F.lit(0.0))
    parts = slopes.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(t - 1))))
    parts = parts.withColumns({f: F.col(f) + F.col(f"_{f}") * F.col("_k") / t for f in features} | {"t_idx": F.col("t_idx") * t + F.col("_k")})
    return parts.drop("_k", *[f"_{f}" for f in features])


def _targets(length: int, factor: int, centered: bool) -> list[tuple[int, int, float]]:
    """For each fine place: the lower coarse place and the share of the next one, going on beyond the ends."""
    out = []
    for k in range(length * factor):
        x = (k + 0.5) / factor - 0.5 if centered else k / factor
        low = min(max(int(x // 1), 0), max(length - 2, 0))
        out.append((k, low, x - low if length > 1 else 0.0))
    return out


def _refine_axis(df: DataFrame, feature: str, axis: str, length: int, factor: int, by: list[str], centered: bool) -> DataFrame:
    if factor == 1:
        return df.select(*by, axis, feature)
    table = df.sparkSession.createDataFrame([(low + o, k, (1 - w) if o == 0 else w) for k, low, w in _targets(length, factor, centered) for o in ((0, 1) if length > 1 else (0,))], f"{axis} int, _k int, _w double")
    return df.join(F.broadcast(table), axis).groupBy(*by, F.col("_k").alias(axis)).agg(F.sum(F.col(feature) * F.col("_w")).alias(feature))


def interpolate(df: DataFrame, feature: str, rows: int, columns: int, steps: int, s: int, t: int, t_centered: bool = False) -> DataFrame:
    """Linear refinement in rows, columns and time: cells are centred, times too if asked; beyond the ends lines go on.

    The three axes are refined one after the other; each is an equi join with a table of weights.
    """
    df = _refine_axis(df, feature, "south_north", rows, s, ["west_east", "t_idx"], True)
    df = _refine_axis(df, feature, "west_east", columns, s, ["south_north", "t_idx"], True)
    return _refine_axis(df, feature, "t_idx", steps, t, ["south_north", "west_east"], t_centered)


def fine_coordinates(grid: DataFrame, rows: int, columns: int, s: int) -> DataFrame:
    """Coordinates of a grid ``s`` times as fine, on the plane through the coarse cells' centres."""
    cells = grid.withColumn("t_idx", F.lit(0))
    lat = interpolate(cells, "latitude", rows, columns, 1, s, 1)
    return lat.join(interpolate(cells, "longitude", rows, columns, 1, s, 1), ["south_north", "west_east", "t_idx"]).drop("t_idx")


def pad_coordinates(grid: DataFrame, rows: int, columns: int) -> DataFrame:
    """One more ring of cells around the grid, as far again as the two outer ones; places run from -1."""
    place = lambda n: [(k, min(max(k, 0), max(n - 2, 0)), o) for k in range(-1, n + 1) for o in ((0, 1) if n > 1 else (0,))]
    def pad(df: DataFrame, axis: str, n: int, other: str) -> DataFrame:
        rows_ = [(low + o, k, (1 - (k - low)) if o == 0 else float(k - low)) for k, low, o in place(n)]
        table = df.sparkSession.createDataFrame([(a, k, float(w) if n > 1 else 1.0) for a, k, w in rows_], f"{axis} int, _k int, _w double")
        return df.join(F.broadcast(table), axis).groupBy(other, F.col("_k").alias(axis)).agg(*[F.sum(F.col(c) * F.col("_w")).alias(c) for c in ("latitude", "longitude")])

    return pad(pad(grid, "south_north", rows, "west_east"), "west_east", columns, "south_north")


def repeat_in_time(static: DataFrame, times: DataFrame) -> DataFrame:
    """A field without time at every time; the times are the small side."""
    return static.crossJoin(F.broadcast(times))


def split_evenly(df: DataFrame, order: str, n: int, name: str = "group") -> DataFrame:
    """``df`` with its group 0 to n - 1 of near-equal groups along ``order``, larger ones first; nulls come first.

    Rows are dealt into ranges; each is ranked by itself, behind the numbers of rows of the ranges before it.
    """
    ranged = cut(df.repartitionByRange(F.col(order).asc_nulls_first()).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    along = Window.partitionBy(F.lit(0)).orderBy("_range")  # one row a range
    before = sizes.select("_range", (F.sum("_n").over(along) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_all"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(F.col(order).asc_nulls_first())) - 1 + F.col("_before")
    size, more = F.floor(F.col("_all") / n), F.col("_all") % n
    group = F.when(F.col("_rank") < more * (size + 1), F.floor(F.col("_rank") / (size + 1))).otherwise(more + F.floor((F.col("_rank") - more * (size + 1)) / F.greatest(size, F.lit(1))))
    return ranged.join(F.broadcast(before), "_range").withColumn("_rank", rank).withColumn(name, group.cast("int")).select(*df.columns, name)
