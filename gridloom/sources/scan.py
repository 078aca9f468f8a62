"""Reading data sets: paths, formats, standard columns, caches.

Parquet, ORC, CSV and JSON come with Spark. Other array formats plug in: a reader is a
function (spark, paths) to a DataFrame, registered by file extension.
"""

from __future__ import annotations

import glob
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.neighbors import nn_join
from ..operators.standardize import standardize

Reader = Callable[[SparkSession, list[str]], DataFrame]

READERS: dict[str, Reader] = {
    "parquet": lambda spark, paths: spark.read.option("mergeSchema", "true").parquet(*paths),
    "orc": lambda spark, paths: spark.read.orc(paths),
    "csv": lambda spark, paths: spark.read.option("header", "true").option("inferSchema", "true").csv(paths),
    "json": lambda spark, paths: spark.read.json(paths),
}


def register(extension: str, reader: Reader) -> None:
    READERS[extension.lower().lstrip(".")] = reader


def source_type(paths: list[str]) -> str:
    """The files' common extension; mixed ones raise, an unknown one too."""
    kinds = {p.rstrip("/").rpartition(".")[2].lower() for p in paths}
    if len(kinds) != 1 or not kinds <= set(READERS):
        raise ValueError(f"cannot read {sorted(kinds)}; known: {sorted(READERS)}")
    return kinds.pop()


def expand(paths: str | list[str]) -> list[str]:
    """Sorted different paths; local patterns are expanded and must match, others are left to Spark."""
    out = set()
    for p in [paths] if isinstance(paths, str) else paths:
        if "://" in p or not any(c in p for c in "*?["):
            out.add(p)
        else:
            found = glob.glob(p)
            if not found:
                raise FileNotFoundError(p)
            out.update(found)
    if not out:
        raise FileNotFoundError("no paths given")
    return sorted(out)


def scan(spark: SparkSession, paths: str | list[str], features: list[str] | str = "all", reader: Reader | None = None, **options) -> DataFrame:
    """Files of one kind as one standard frame; ``options`` go to :func:`standardize`."""
    files = expand(paths)
    return standardize((reader or READERS[source_type(files)])(spark, files), features=features, **options)


def grid_from_axes(lats: DataFrame, lons: DataFrame) -> DataFrame:
    """A grid from one-dimensional coordinates; longitudes are the small side."""
    from ..operators.standardize import grid_index

    return grid_index(lats.select("latitude").crossJoin(F.broadcast(lons.select("longitude"))))


def cached(spark: SparkSession, pattern: str, features: list[str]) -> tuple[list[str], list[str]]:
    """Features whose cache ``pattern`` (with {feature}) exists, and those that lack one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def there(f: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(pattern.format(feature=f) + "/_SUCCESS")
        return path.getFileSystem(conf).exists(path)

    have = [f for f in features if there(f)]
    return have, [f for f in features if f not in have]


def read_cached(spark: SparkSession, pattern: str, features: list[str], keys: list[str]) -> DataFrame:
    """Cached features side by side."""
    out = None
    for f in features:
        df = spark.read.parquet(pattern.format(feature=f))
        out = df if out is None else out.join(df, keys)
    return out


def bias_factors(spark: SparkSession, path: str, columns: list[str], gids: DataFrame | None = None, cells: DataFrame | None = None, threshold: float = 0.1) -> DataFrame:
    """A table of factors; missing columns raise; only the given sites with ``gids``.

    With ``cells`` (gid, latitude, longitude): the factors of the nearest place under the cell's gid; a cell with none within ``threshold`` degrees raises.
    """
    df = spark.read.parquet(path)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"{path} lacks {missing}")
    df = df.select("gid", *[c for c in df.columns if c != "gid"])
    if cells is not None:
        near = nn_join(cells, df.select("gid", "latitude", "longitude").distinct(), threshold)
        far = near.where("tid is null").count()
        if far:
            raise ValueError(f"{far} cells have no factors within {threshold} degrees")
        return near.select("sid", "tid").join(df.drop("latitude", "longitude"), F.col("tid") == F.col("gid")).drop("gid", "tid").withColumnRenamed("sid", "gid")
    return df if gids is None else df.join(gids.select("gid"), "gid", "left_semi")
