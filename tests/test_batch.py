"""Sized files, kept indices, daylight windows, temporal sets, jobs side by side, collected chunks."""

import math
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import bias, collect, sampling, solar
from gridloom.plans import cli
from gridloom.sources import index, sinks


def test_files_keep_to_their_size(spark, tmp_path):
    df = spark.range(60_000).selectExpr("id", "rand(1) as x", "cast(id % 5 as string) as kind")
    path = str(tmp_path / "sized")
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    limit = sinks.write_sized(df, path, 100 << 10)
    files = sinks.written_files(spark, path).collect()
    assert sum(f["rows"] for f in files) == 60_000 and max(f["rows"] for f in files) <= limit
    full = [f["bytes"] for f in files if f["rows"] == limit]
    assert len(full) >= 3 and all(60 << 10 < b < 140 << 10 for b in full)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == before
    assert sinks.write_sized(df.limit(0), str(tmp_path / "none"), 1000) == 1


def test_kept_tables_join_without_an_exchange(spark, tmp_path):
    cells = spark.range(5000).selectExpr("id as gid", "cast(id / 50 as int) as south_north", "cast(id % 50 as int) as west_east")
    one = index.keep_by_gid(cells, "kept_cells", str(tmp_path / "a"), 4)
    two = index.keep_by_gid(cells.selectExpr("gid", "gid * 2 as factor"), "kept_factors", str(tmp_path / "b"), 4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = one.join(two, "gid")
        assert joined.where("factor = 2 * gid").count() == 5000
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        index.drop_index(spark, "kept_cells")
        index.drop_index(spark, "kept_factors")


def test_a_raster_index_is_found_once(spark, tmp_path):
    grid = spark.range(100).selectExpr("id as gid", "cast(id / 10 as int) as south_north", "cast(id % 10 as int) as west_east", "40 - 0.5 * cast(id / 10 as int) as latitude", "-105 + 0.5 * (id % 10) as longitude")
    first = index.raster_index(grid, (38.0, -103.0), (3, 4), "kept_crop", str(tmp_path / "crop"), 2)
    try:
        assert first.count() == 12 and first.agg(F.max("south_north"), F.max("west_east")).first() == (2, 3)
        again = index.raster_index(grid.limit(0), (38.0, -103.0), (3, 4), "kept_crop")
        assert sorted(map(str, again.collect())) == sorted(map(str, first.collect()))
    finally:
        index.drop_index(spark, "kept_crop")


def test_windows_lie_around_the_daylight(spark):
    light = {0: range(6, 18), 1: range(9, 15), 2: range(0), 3: range(0, 24)}
    rows = [(24 * d + h, c, None if h not in light[d] or (c == 1 and d == 1 and h == 9) else 0.5) for d in light for h in range(24) for c in (0, 1)]
    df = spark.createDataFrame(rows, "t_idx int, gid int, clearsky_ratio double")
    got = {r["day"]: (r["first_light"], r["light"], r["start"], r["stop"]) for r in sampling.daylight_windows(df, 8).collect()}
    # day 0: 12 of light, two cut off; day 1: one cell is dark at nine, 5 left, padding 3 -> 2 before; day 2: whole; day 3: 24 of light
    assert got == {0: (6, 12, 8, 16), 1: (34, 5, 32, 40), 2: (None, 0, 48, 72), 3: (72, 24, 80, 88)}
    samples = sampling.daylight_samples(df, sampling.daylight_windows(df, 8), [0, 1]).where("gid = 0").orderBy("t_idx").collect()
    assert [(r["day"], r["t"], r["t_idx"]) for r in samples] == [(0, k, 8 + k) for k in range(8)] + [(1, k, 32 + k) for k in range(8)]
    days = sampling.draw_days(4, 10, random.Random(1))
    assert len(days) == 10 and set(days) <= set(range(4))


def test_temporal_sets_overlap(spark):
    files = spark.createDataFrame([(t, s, f"out_{t:06d}_{s:06d}.parquet") for t in (0, 1, 4) for s in (0, 1)], "t_chunk int, s_chunk int, file string")
    got = {(r["t_chunk"], r["s_chunk"]): ([f[4:10] for f in r["files"]], r["start"], r["stop"]) for r in solar.temporal_sets(files).collect()}
    assert got[0, 1] == (["000000", "000001"], 0, 24) and got[1, 0] == (["000000", "000001", "000004"], 24, 48) and got[4, 0] == (["000001", "000004"], 24, 48)


def test_hours_are_rolled_over_three_chunks(spark):
    days, longitude = 4, {1: -105.0, 2: 0.0, 3: 60.0}
    local = {g: np.arange(days * 24) + 1000.0 * g for g in longitude}
    rows = [(0, d, h, g, longitude[g], float(local[g][24 * d + h])) for g in longitude for d in range(days) for h in range(24)]
    df = spark.createDataFrame(rows, "s_chunk int, t_chunk int, hour int, gid int, longitude double, x double")
    got = {(r["t_chunk"], r["gid"], r["hour"]): r["x"] for r in solar.to_utc_by_chunk(df, ["x"]).collect()}
    assert len(got) == days * 24 * 3
    for d in range(days):
        lo, hi = max(d - 1, 0), min(d + 2, days)
        for g in longitude:
            axis = np.roll(local[g][lo * 24 : hi * 24], -round(longitude[g] / 15))
            assert [got[d, g, h] for h in range(24)] == axis[(d - lo) * 24 :][:24].tolist()
    only = solar.to_utc_by_chunk(df, ["x"], ids=spark.createDataFrame([(2,)], "t_chunk int"))
    assert {r["t_chunk"] for r in only.collect()} == {2} and only.count() == 72


def test_jobs_run_side_by_side(spark, tmp_path):
    meet, pools = threading.Barrier(2, timeout=60), {}

    def job(name):
        meet.wait()  # goes on only when both have begun
        pools[name] = spark.sparkContext.getLocalProperty("spark.scheduler.pool")

    cli.side_by_side(spark, {n: (lambda n=n: job(n)) for n in ("a", "b")})
    assert pools == {"a": "a", "b": "b"} and spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    with pytest.raises(RuntimeError, match="1 of 2 jobs failed, b"):
        cli.side_by_side(spark, {"a": lambda: None, "b": lambda: 1 / 0})


def test_collect_splits_features_and_stores_integers(spark, tmp_path):
    for k in range(2):
        rows = [(g, f"2020-01-0{k + 1} 00:00:00", 5.014 + g, 20.0 + k) for g in range(4)]
        spark.createDataFrame(rows, "gid int, time string, windspeed_100m double, temperature_2m double").withColumn("time", F.to_timestamp("time")).write.parquet(str(tmp_path / f"c{k}"))
    out = str(tmp_path / "out_{feature}")
    cli.run(spark, [{"command": "data-collect", "sources": [str(tmp_path / "c0"), str(tmp_path / "c1")], "out": out, "dset_split": True, "integers": True}])
    wind, warm = (spark.read.parquet(out.format(feature=f)) for f in ("windspeed_100m", "temperature_2m"))
    assert wind.columns == ["gid", "time", "windspeed_100m"] and dict(wind.dtypes)["windspeed_100m"] == "int" and wind.count() == warm.count() == 8
    assert sorted({r["windspeed_100m"] for r in wind.collect()}) == [501, 601, 701, 801] and wind.schema["windspeed_100m"].metadata["scale_factor"] == 100.0
    with pytest.raises(ValueError, match="feature"):
        cli.data_collect(spark, [str(tmp_path / "c0")], str(tmp_path / "x"), dset_split=True)


def test_chunks_that_disagree_give_the_first_ones_rows(spark):
    frame = lambda rows: spark.createDataFrame(rows, "gid int, time int, x double")
    a, b = frame([(1, 1, 1.0), (1, 2, None)]), frame([(1, 2, 2.0), (1, 3, 3.0), (1, 1, 9.0)])
    assert {(r["time"], r["x"]) for r in collect.combine([a, b]).collect()} == {(1, 1.0), (2, None), (3, 3.0)}
    assert collect.combine([a, b]).columns == ["gid", "time", "x"] and collect.combine([a, b], overlap=False).count() == 5
    meta = frame([(g, 0, 0.0) for g in (5, 1, 3, 9)])
    assert {(r["gid"], r["row"]) for r in collect.place(frame([(3, 0, 0.0), (5, 0, 0.0)]), meta).collect()} == {(3, 1), (5, 2)}
    with pytest.raises(ValueError, match="lie on"):
        collect.place(frame([(1, 0, 0.0), (5, 0, 0.0)]), meta)
    with pytest.raises(ValueError, match="not in"):
        collect.place(frame([(4, 0, 0.0)]), meta, strict=True)
    with pytest.warns(UserWarning, match="left out"):
        assert collect.place(frame([(4, 0, 0.0), (5, 0, 0.0)]), meta).count() == 1


def test_a_mapped_value_that_is_not_finite_raises(spark):
    times = spark.range(40).selectExpr("0 as gid", "timestamp_seconds(id * 86400) as time", "cast(id + 1 as double) as x")
    params = bias.qdm_params(times, times, times, "x", 1, 800.0, [0.0, 0.5, 1.0]).cache()
    assert bias.apply_qdm(times, params, "x", 1, levels=[0.0, 0.5, 1.0]).where("x is not null").count() == 40
    with pytest.raises(Exception, match="not finite"):
        bias.apply_qdm(times.withColumn("x", F.lit(math.inf)), params, "x", 1, levels=[0.0, 0.5, 1.0]).collect()


def test_handlers_by_name_and_gaps_along_an_axis(spark):
    from gridloom.plans.handler import Handler, handler_by_name, register_handler

    rows = [(0, j, k, None if j == 2 else 10.0 * j + k) for j in range(5) for k in range(3)]
    df = spark.createDataFrame(rows, "south_north int, west_east int, k int, temperature_2m double").withColumns({"time": F.timestamp_seconds(F.col("k") * 3600), "latitude": F.lit(1.0), "longitude": F.lit(2.0)}).drop("k")
    got = handler_by_name("base", features=["temperature_2m"], gaps="linear", gaps_along="west_east").run(df)
    assert {(r["west_east"], r["time"].hour, r["temperature_2m"]) for r in got.collect()} == {(j, k, 10.0 * j + k) for j in range(5) for k in range(3)}
    register_handler("rolled", lambda **o: Handler(time_roll=1, **o))
    rolled = {(r["west_east"], r["time"].hour): r["temperature_2m"] for r in handler_by_name("rolled", features=["temperature_2m"]).run(df).collect()}
    assert rolled[1, 0] == 12.0 and rolled[1, 1] == 10.0 and rolled[2, 0] is None
    with pytest.raises(ValueError, match="known"):
        handler_by_name("other", features=[])


def test_factors_with_gaps_are_not_smoothed(spark):
    factors = spark.createDataFrame([(0, 0, 0, 0, 1.0, 0.0), (1, 0, 1, 0, None, 0.0)], "gid int, south_north int, west_east int, t_idx int, scalar double, adder double")
    with pytest.raises(ValueError, match="gaps"):
        bias.smooth_factors(factors, 1.0)
    assert {(r["gid"], round(r["scalar"], 9)) for r in bias.smooth_factors(factors.fillna(3.0), 50.0).collect()} != set()


def test_an_epoch_holds_the_same_samples_as_its_batches(spark):
    cube = spark.range(8 * 8 * 12).selectExpr("cast(id / 96 as int) as south_north", "cast(id / 12 % 8 as int) as west_east", "cast(id % 12 as int) as t_idx", "cast(id as double) as x", "id * 2.0D as y")
    queue = lambda: sampling.BatchQueue([(cube, 8, 8, 12), (cube.withColumn("x", -F.col("x")), 8, 8, 12)], ["x", "y"], (4, 4, 6), 2, 2, batch_size=3, n_batches=2, seed=3, smoothing=0.5, smoothing_ignore=("y",))
    coarse, fine = queue().epoch()
    for b, (low, high) in enumerate(queue()):
        for whole, one in ((fine, high), (coarse, low)):
            mine = whole.where(F.col("batch") == b).drop("batch")
            flat = lambda df: sorted((r["obs"], r["south_north"], r["west_east"], r["t_idx"], round(r["x"], 6), round(r["y"], 6)) for r in df.collect())
            assert flat(mine) == flat(one) and mine.count() > 0
