"""Cell tables kept in buckets of gid, so that joins on gid need no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import raster
from ..store import new_folder

BUCKETS = 32


def keep_by_gid(df: DataFrame, name: str, path: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``df`` as a table in buckets of gid, sorted within; tables with the same number of buckets join on gid without an exchange."""
    spark = df.sparkSession
    # one task a bucket, so that a bucket is one file
    dealt = df.repartition(buckets, "gid").sortWithinPartitions("gid")
    dealt.write.option("path", path or new_folder(spark, "table")).bucketBy(buckets, "gid").sortBy("gid").mode("overwrite").saveAsTable(name)
    return spark.table(name)


def cached_index(spark: SparkSession, name: str, build: Callable[[], DataFrame], path: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The table of that name; it is built and kept if there is none."""
    return spark.table(name) if spark.catalog.tableExists(name) else keep_by_gid(build(), name, path, buckets)


def raster_index(grid: DataFrame, target: tuple[float, float], shape: tuple[int, int], name: str, path: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(gid, south_north, west_east, latitude, longitude) of a crop: places in the crop, found once and kept under ``name``."""
    columns = ["gid", "south_north", "west_east", "latitude", "longitude"]
    return cached_index(grid.sparkSession, name, lambda: raster.crop(grid, grid, target, shape).select(*columns), path, buckets)


def drop_index(spark: SparkSession, name: str) -> None:
    spark.sql(f"drop table if exists `{name}`")
