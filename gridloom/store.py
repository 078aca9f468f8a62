"""Cutting lineage and reading settings, so that jobs survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs on one machine, as in local tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session; without one a cluster raises."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(LOCAL_CHECKPOINTS)
    return LOCAL_CHECKPOINTS


def new_folder(spark: SparkSession, kind: str = "out") -> str:
    """A folder name of its own in the shared folder; what is written there goes with the session."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later jobs start from the files, which go with the session at the latest."""
    spark = df.sparkSession
    path = new_folder(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a partition that ``dealt`` aims at.
DEALT_ROWS = 1 << 18


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by its keys in as many partitions as keep some ``DEALT_ROWS`` rows each, the session's shuffle partitions at least.

    What joins and groups by the same keys then has tasks of one size however large ``df`` is; adaptive execution does not merge them.
    Counting runs ``df`` once more: give it a scan or a frame that was cut.
    """
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(most, -(-df.count() // DEALT_ROWS)), *keys)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it as long as ``df`` has a column of that name (letters' case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, column: str) -> tuple[DataFrame, str]:
    """``df`` with a BIGINT column that orders rows as ``column`` does (null stays null), and that column's name.

    Whole numbers are taken as they are; values of other types are sorted once over all rows and joined back.
    """
    name = free_name(df, "number")
    if dict(df.dtypes)[column] in ("tinyint", "smallint", "int", "bigint"):
        return df.withColumn(name, F.col(column).cast("long")), name
    key = free_name(df, "key")
    ranked = cut(df.where(F.col(column).isNotNull()).select(F.col(column).alias(key)).distinct().orderBy(key).withColumn(name, F.monotonically_increasing_id()))
    return df.join(ranked, F.col(column) == F.col(key), "left").drop(key), name


def ranked(df: DataFrame, *order: Column, within: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """``df`` with each row's place from 1 on in the given order, among all rows or among those that agree in ``within``.

    Rows are dealt into ranges of the order and numbered there; only the ranges' lengths are added up, so no task holds more
    than its range. Spark runs ``df`` twice to find the ranges: give it a frame that was cut. Rows that tie in ``order`` get
    different places; nulls of ``within`` are a group of their own.
    """
    place, stretch, rows, before = (free_name(df, c) for c in ("place", "stretch", "rows", "before"))
    held = cut(df.orderBy(*within, *order).withColumn(place, F.monotonically_increasing_id()))
    keys = [F.shiftright(place, 33).alias(stretch), *within]
    sizes = held.groupBy(*keys).agg(F.count(F.lit(1)).alias(rows), F.min(place).alias(place))
    ahead = Window.partitionBy(*within).orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(stretch, *within, (F.coalesce(F.sum(rows).over(ahead), F.lit(0)) - F.col(place)).alias(before))
    same = F.shiftright(F.col(f"h.{place}"), 33) == F.col(f"s.{stretch}")
    for c in within:
        same &= F.col(f"h.`{c}`").eqNullSafe(F.col(f"s.`{c}`"))
    joined = held.alias("h").join(starts.alias("s"), same)
    return joined.select(*[F.col(f"h.`{c}`") for c in df.columns], (F.col(f"h.{place}") + F.col(before) + 1).alias(name))


def drop_cut(df: DataFrame) -> None:
    """Remove the files behind a frame returned by :func:`cut` once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in folders:
        if "/cut-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
