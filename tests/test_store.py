"""Ranks over ranges and shared folders."""

import random

from pyspark.sql import functions as F

from gridloom.store import cut, ranked


def test_ranks_over_ranges_and_within_groups(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), rng.randint(0, 30), "x") for i in range(5_000)]
    df = cut(spark.createDataFrame(rows, "i long, g string, v int, place string").repartition(7))
    got = {r["i"]: r["rank"] for r in ranked(df, F.desc("v"), F.asc("i")).collect()}
    assert got == {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])), 1)}
    by = {r["i"]: r["rank"] for r in ranked(df, F.desc("v"), F.asc("i"), within=("g",)).collect()}
    for g in ("a", "b", None):
        assert {r[0]: by[r[0]] for r in rows if r[1] == g} == {r[0]: k for k, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0])), 1)}
    assert ranked(df.limit(0), F.col("v")).collect() == []


def test_partitions_grow_with_the_rows(spark, monkeypatch):
    from gridloom import store

    monkeypatch.setattr(store, "DEALT_ROWS", 100)
    df = spark.range(950).selectExpr("id % 90 as k", "id as v")
    assert store.dealt(df, "k").rdd.getNumPartitions() == 10 and store.dealt(df.limit(7), "k").rdd.getNumPartitions() == 4
    assert store.dealt(df, "k").groupBy("k").count().count() == 90
