import os

import pytest
from pyspark.sql import SparkSession

os.environ.setdefault("TZ", "UTC")
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.warehouse.dir", "/tmp/gridloom-tests/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from gridloom.session import make_importable

    yield make_importable(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA
