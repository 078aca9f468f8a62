"""Nearest-neighbour joins by buckets: an equi join on grid squares, never all pairs.

Each source point looks in the 3 by 3 squares around its own, so a target within one
square's width is found for sure. ``nearest`` without a bound widens the squares for the
points that found nothing, until all have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import cut


def _squares(points: DataFrame, width: float, id_column: str, prefix: str) -> DataFrame:
    return points.select(
        F.col(id_column).alias(f"{prefix}id"), F.col("latitude").alias(f"{prefix}lat"), F.col("longitude").alias(f"{prefix}lon"),
        F.floor(F.col("latitude") / width).alias("y"), F.floor(F.col("longitude") / width).alias("x"),
    )


def within(source: DataFrame, target: DataFrame, bound: float, source_id: str = "gid", target_id: str = "gid") -> DataFrame:
    """(sid, tid, distance): all pairs nearer than ``bound`` degrees. Coordinates that are decimals are subtracted as such."""
    near = F.expr("sequence(-1, 1)")
    looked = _squares(source, bound, source_id, "s").select("sid", "slat", "slon", "x", F.explode(F.transform(near, lambda d: F.col("y") + d)).alias("y"))
    looked = looked.select("sid", "slat", "slon", "y", F.explode(F.transform(near, lambda d: F.col("x") + d)).alias("x"))
    pairs = looked.join(_squares(target, bound, target_id, "t"), ["y", "x"])
    down, right = ((F.col(f"s{c}") - F.col(f"t{c}")).cast("double") for c in ("lat", "lon"))
    distance = F.sqrt(down * down + right * right)
    return pairs.select("sid", "tid", distance.alias("distance")).where(F.col("distance") < bound)


def nn_join(source: DataFrame, target: DataFrame, bound: float, source_id: str = "gid", target_id: str = "gid") -> DataFrame:
    """(sid, tid, distance) for every source point: its nearest target within the bound (least id on a tie), else null."""
    best = within(source, target, bound, source_id, target_id).groupBy("sid").agg(F.min(F.struct("distance", "tid")).alias("best"))
    return source.select(F.col(source_id).alias("sid")).join(best, "sid", "left").select("sid", F.col("best.tid").alias("tid"), F.col("best.distance").alias("distance"))


def knn_join(source: DataFrame, target: DataFrame, k: int, bound: float, source_id: str = "gid", target_id: str = "gid") -> DataFrame:
    """(sid, tid, distance, rank): up to ``k`` nearest targets within the bound."""
    order = Window.partitionBy("sid").orderBy("distance", "tid")
    return within(source, target, bound, source_id, target_id).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(source: DataFrame, target: DataFrame, width: float | None = None, source_id: str = "gid", target_id: str = "gid") -> DataFrame:
    """(sid, tid, distance): the nearest target of every source point at any distance; null without any target or without coordinates.

    Squares start at ``width``, else at the side of the mean area a target has, and grow fourfold for the points
    that are still without one, until all have theirs. Each round's finds are written, so a round's plan does not hold those before it.
    """
    known = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    target = target.where(known)
    span = target.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in ("latitude", "longitude") for k, f in (("lo", F.min), ("hi", F.max))]).first()
    nowhere = source.where(~known) if span["n"] else source
    found = nowhere.select(F.col(source_id).alias("sid"), F.lit(None).cast(target.schema[target_id].dataType).alias("tid"), F.lit(None).cast("double").alias("distance"))
    if not span["n"]:
        return found
    area = float(span["hi_latitude"] - span["lo_latitude"]) * float(span["hi_longitude"] - span["lo_longitude"])
    width = width or max((area / span["n"]) ** 0.5, 1e-3)
    left = cut(source.where(known).select(source_id, "latitude", "longitude"))
    while not left.isEmpty():
        got = cut(nn_join(left, target, width, source_id, target_id).where("tid is not null"))
        found = found.unionByName(got)
        left = cut(left.join(got.select(F.col("sid").alias(source_id)), source_id, "left_anti"))
        width *= 4
    return found


def default_bound(grid: DataFrame) -> DataFrame:
    """(bound): the larger of the coordinates' median step between rows and columns, most over the columns and rows."""
    down, right = Window.partitionBy("west_east").orderBy("south_north"), Window.partitionBy("south_north").orderBy("west_east")
    steps = grid.select("south_north", "west_east", F.abs(F.col("latitude") - F.lag("latitude").over(down)).alias("dlat"), F.abs(F.col("longitude") - F.lag("longitude").over(right)).alias("dlon"))
    lat = steps.groupBy("west_east").agg(F.percentile("dlat", 0.5).alias("m")).agg(F.max("m").alias("m"))
    lon = steps.groupBy("south_north").agg(F.percentile("dlon", 0.5).alias("m")).agg(F.max("m").alias("m"))
    return lat.unionByName(lon).agg(F.max("m").alias("bound"))


def group_mean(source: DataFrame, target: DataFrame, features: list[str], bound: float, by_time: bool = False, times: DataFrame | None = None) -> DataFrame:
    """Mean of the source points nearest to each target cell; cells that none is nearest to have null.

    ``by_time``: at each of the ``times`` (the source's own if not given); source rows at other times count for nothing.
    """
    if by_time and times is not None:
        times = times.select("time").distinct()
        source = source.join(times, "time", "left_semi")
    mapped = source.join(nn_join(source.select("gid", "latitude", "longitude").distinct(), target, bound).where("tid is not null"), F.col("gid") == F.col("sid"))
    keys = ["tid", *["time"] * by_time]
    means = mapped.groupBy(*keys).agg(*[F.avg(f).alias(f) for f in features])
    cells = target.select(F.col("gid").alias("tid"))
    if by_time:
        cells = cells.crossJoin(F.broadcast(source.select("time").distinct() if times is None else times))
    return cells.join(means, keys, "left").withColumnRenamed("tid", "gid")


def observation_cover(raster: DataFrame, feature: str) -> DataFrame:
    return raster.agg((F.count(feature) / F.count("*")).alias("cover"))


def inverse_map(mapping: DataFrame) -> DataFrame:
    """(tid, sids): all source points whose nearest target it is."""
    return mapping.where("tid is not null").groupBy("tid").agg(F.sort_array(F.collect_list("sid")).alias("sids"))


def same_places(meta: DataFrame, wanted: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Rows of ``meta`` that lie on a wanted coordinate."""
    hits = within(meta, wanted, tolerance, "gid", "gid").select(F.col("sid").alias("gid")).distinct()
    return meta.join(hits, "gid", "left_semi")


def regrid(source: DataFrame, target: DataFrame, features: list[str], k: int, bound: float) -> DataFrame:
    """Inverse-distance weighted mean of the ``k`` nearest source points; a coincident one alone counts."""
    pairs = knn_join(target, source.select("gid", "latitude", "longitude").distinct(), k, bound)
    weighted = pairs.withColumn("w", 1 / F.greatest(F.col("distance"), F.lit(1e-9))).join(source, F.col("tid") == F.col("gid"))
    extra = ["time"] if "time" in source.columns else []
    mean = lambda f: F.sum(F.col("w") * F.col(f)) / F.sum(F.when(F.col(f).isNotNull(), F.col("w")))
    return weighted.groupBy(F.col("sid").alias("cell"), *extra).agg(*[mean(f).alias(f) for f in features])
