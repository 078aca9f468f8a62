"""Writing data sets; Spark commits each job's files at once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import OUTPUT
from ..functions.names import parse_feature
from ..functions.scalars import enforce
from ..store import new_folder


def with_attributes(df: DataFrame, features: list[str]) -> DataFrame:
    """Units and scale factors of known features as column metadata."""
    for f in features:
        known = OUTPUT.get(parse_feature(f).base)
        if known:
            df = df.withMetadata(f, {"scale_factor": known[0], "units": known[1], "dtype": known[2]})
    return df


def write_features(df: DataFrame, pattern: str, features: list[str], keys: list[str], overwrite: bool = False) -> list[str]:
    """One data set a feature; existing ones stay unless ``overwrite``. Returns what was written."""
    from .scan import cached

    done, _ = ([], features) if overwrite else cached(df.sparkSession, pattern, features)
    todo = [f for f in features if f not in done]
    for f in todo:
        with_attributes(df.select(*keys, f), [f]).write.mode("overwrite" if overwrite else "errorifexists").parquet(pattern.format(feature=f))
    return todo


def write_output(df: DataFrame, path: str, features: list[str], limits: bool = True, partition: list[str] | None = None, mode: str = "errorifexists", integers: bool = False) -> None:
    """A result with features held to their limits, partitioned as asked; with ``integers`` as :func:`stored` has them."""
    if integers:
        df = stored(df, features)
    elif limits:
        df = df.withColumns({f: enforce(f, F.col(f)) for f in features})
    writer = with_attributes(df, features).write.mode(mode)
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


#: Spark's type that holds all values of a stored type; it has no unsigned ones.
STORED = {"uint8": "short", "int16": "short", "uint16": "int", "int32": "int", "float32": "float"}


def stored(df: DataFrame, features: list[str]) -> DataFrame:
    """Known features as they are stored: held to their limits, times the scale factor, whole types rounded half to even; others stay.

    :func:`gridloom.operators.standardize.unscale` with the ``scale_factor`` of the columns' metadata takes them back.
    """
    for f in features:
        known = OUTPUT.get(parse_feature(f).base)
        if known:
            scaled = enforce(f, F.col(f)) * F.lit(known[0])
            whole = F.rint(scaled) if "int" in known[2] else scaled
            df = df.withColumn(f, whole.cast(STORED[known[2]]))
    return with_attributes(df, features)


#: Rows from which the bytes of a row are measured, at most; they steer the files' sizes alone.
MEASURED_ROWS = 20_000


def bytes_per_row(df: DataFrame, rows: int = MEASURED_ROWS) -> float:
    """What a row takes in a file, from the first rows written to the shared folder; 0 for an empty frame."""
    probe = new_folder(df.sparkSession, "probe")
    df.limit(rows).coalesce(1).write.parquet(probe)
    seen = written_files(df.sparkSession, probe).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).first()
    return seen["bytes"] / seen["rows"] if seen["rows"] else 0.0


def written_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, rows) of a data set."""
    return spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.first("_metadata.file_size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def write_sized(df: DataFrame, path: str, target_bytes: int, by: tuple[str, ...] = (), mode: str = "errorifexists") -> int:
    """Files of about ``target_bytes``; the number of rows that bounds each is returned.

    Bytes a row are measured first. Spark rebalances the result (by the columns ``by``, so that what belongs together lies together)
    into partitions of some files each, splitting large ones and merging small ones, and closes a file at the limit.
    """
    spark = df.sparkSession
    each = bytes_per_row(df)
    limit = max(1, int(target_bytes / each)) if each else 1
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name, None)
    # what is shuffled is larger than what is stored: fixed widths against encoded columns
    spark.conf.set(name, str(max(1 << 16, limit * 8 * (len(df.columns) + 1))))
    try:
        df.hint("rebalance", *by).write.option("maxRecordsPerFile", limit).mode(mode).parquet(path)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return limit


def write_factors(df: DataFrame, path: str, meta: dict) -> None:
    """Bias factors with their settings beside them as one JSON row."""
    df.write.parquet(path)
    df.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").coalesce(1).write.text(f"{path.rstrip('/')}.meta")


def read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path.rstrip('/')}.meta").first()[0])


def save_stats(stats: DataFrame, path: str) -> None:
    """(feature, mean, std) as JSON lines; one row a feature."""
    stats.coalesce(1).write.mode("overwrite").json(path)


def load_stats(spark: SparkSession, path: str) -> tuple[dict[str, float], dict[str, float]]:
    rows = spark.read.json(path).collect()
    return {r["feature"]: r["mean"] for r in rows}, {r["feature"]: r["std"] for r in rows}
