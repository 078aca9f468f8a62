"""Settings of a session that the library needs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: Arrow batches to Python workers hold about this many bytes, as texts can be long; a session's own setting stands.
BATCH_BYTES, DEFAULT_BATCH_BYTES = 4 << 20, "67108864b"


def make_importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver was started, and bound what they get at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == DEFAULT_BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark
