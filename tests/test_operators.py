"""Operators against NumPy, exact cases, and identities."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import names, scalars
from gridloom.functions import times as T
from gridloom.operators import bias, chunks, coarsen, collect, grid, losses, models, neighbors, profiles, qa, raster, sampling, solar, stats, windows
from gridloom.plans import cli
from gridloom.plans.features import derive, find_rule, BASE
from gridloom.plans.handler import Handler, daily_pair
from gridloom.sources import scan, sinks


@pytest.fixture(scope="module")
def cube_array():
    return np.random.default_rng(42).uniform(-10, 10, (6, 4, 12, 2))


@pytest.fixture(scope="module")
def cube(spark, cube_array):
    rows = [(i, j, t, 50.0 - i, -100.0 + j, *map(float, cube_array[i, j, t])) for i in range(6) for j in range(4) for t in range(12)]
    df = spark.createDataFrame(rows, "south_north int, west_east int, t_idx int, latitude double, longitude double, u_10m double, v_10m double")
    return df.withColumn("time", F.timestamp_seconds(F.lit(1672531200) + F.col("t_idx") * 3600)).cache()


def as_array(df, feature, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r[feature] is not None:
            out[r["south_north"], r["west_east"], r["t_idx"]] = r[feature]
    return out


def test_window_mask_cases(spark):
    days = spark.range(1, 366).select(F.col("id").cast("int").alias("doy"))
    for center, size, want in ((60, 3, [59, 60, 61]), (60, 4, [59, 60, 61]), (1, 3, [1, 2, 365]), (365, 3, [1, 364, 365])):
        got = [r["doy"] for r in days.where(T.in_window(F.col("doy"), F.lit(float(center)), size)).orderBy("doy").collect()]
        assert got == want


def test_coarsening_equals_reshape(cube, cube_array):
    got = coarsen.spatial(cube, ["u_10m"], 2, by=("t_idx",))
    want = cube_array[..., 0].reshape(3, 2, 2, 2, 12).mean(axis=(1, 3))
    assert np.allclose(as_array(got, "u_10m", (3, 2, 12)), want)
    for method, how in (("average", np.mean), ("total", np.sum), ("max", np.max), ("min", np.min), ("subsample", lambda x, axis: x[:, :, :, 0])):
        done = coarsen.temporal(cube, ["u_10m"], 4, method).withColumnRenamed("t_block", "t_idx")
        assert np.allclose(as_array(done, "u_10m", (6, 4, 3)), how(cube_array[..., 0].reshape(6, 4, 3, 4), axis=3))
    for bad in (3, 7, 40):
        with pytest.raises(ValueError):
            coarsen.check_divisible(20, 20, bad)


def test_crop_and_threshold(cube):
    cells = cube.select("south_north", "west_east", "latitude", "longitude").distinct()
    done = raster.crop(cube, cells, (45.1, -98.9), (3, 2))
    got = done.agg(F.min("latitude"), F.max("latitude"), F.min("longitude"), F.max("south_north")).first()
    assert tuple(got) == (45.0, 47.0, -99.0, 2)
    with pytest.raises(RuntimeError):
        raster.closest_cell(cells, 0.0, 0.0, 1.0)
    with pytest.raises(ValueError):
        raster.require_features(cube.withColumn("x", F.lit(None).cast("double")), ["x"])
    flags = {r["feature"]: r["failed"] for r in raster.failed_output(cube.withColumn("same", F.lit(1.0)), ["u_10m", "same"]).collect()}
    assert flags == {"u_10m": False, "same": True}


def test_wind_round_trip(cube):
    done = derive(cube, ["windspeed_10m", "winddirection_10m"]).withColumnsRenamed({"u_10m": "u0", "v_10m": "v0"})
    back = derive(done, ["u_10m", "v_10m"])
    worst = back.agg(F.max(F.abs(F.col("u_10m") - F.col("u0"))), F.max(F.abs(F.col("v_10m") - F.col("v0")))).first()
    assert max(worst) < 1e-9


def test_names():
    assert names.parse_feature("U_100m").height == 100 and names.parse_feature("ta_500pa").pressure == 500 and names.parse_feature("ghi").level is None
    assert names.snake("WindSpeedURL") == "wind_speed_url" and names.resolution("30km", 4) == "7.5km" and names.output_names(["u_10m", "v_10m", "ghi"]) == ["windspeed_10m", "winddirection_10m", "ghi"]
    assert names.choose(["a", "ab", "c"], ["a*"]) == ["a", "ab"] and names.choose(["a"], "all") == ["a"]
    with pytest.raises(KeyError):
        names.choose(["a"], "b")
    with pytest.raises(KeyError):
        names.limits("nothing_10m")
    assert find_rule("temperature_max_2m", {"temperature_max_(.*)m": "temperature_(.*)m"}) == "temperature_2m" and find_rule("xyz", BASE) is None


def test_interpolation_of_levels(spark):
    df = spark.createDataFrame([(0, 10.0, 5.0), (0, 40.0, 8.0), (0, 100.0, 12.0)], "k int, lev double, ws double")
    for level, want in ((50, 8.0 + 4 * 10 / 60), (60, 8.0 + 4 * 20 / 60), (5, 5 - 0.5), (120, 12 + 4 / 3)):
        assert profiles.interpolate(df, "ws", level, keys=("k",)).first()["ws"] == pytest.approx(want)
    means = spark.createDataFrame([(1, 0.0, 0.0, h, w) for h, w in ((10, 5.0), (100, 9.0), (120, -999.0), (140, 11.0))], "month int, latitude double, longitude double, height int, ws double")
    got = {r["height"]: r["ws"] for r in profiles.monthly_means_to_heights(means, [10, 40, 120, 200]).collect()}
    assert got == pytest.approx({10: 5, 40: 5 + 4 * 30 / 90, 120: 10, 200: 14})


def test_derived_from_profile(spark):
    surface = spark.createDataFrame([(0, 0, 0, 5.0)], "south_north int, west_east int, time int, u_10m double")
    profile = spark.createDataFrame([(0, 0, 0, 40.0, 8.0), (0, 0, 0, 100.0, 12.0)], "south_north int, west_east int, time int, lev double, u double")
    assert derive(surface, ["u_20m"], profile=profile).first()["u_20m"] == pytest.approx(6.0)
    with pytest.raises(KeyError):
        derive(surface, ["ghi"])


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    p, q = rng.uniform(0, 5, (400, 2)), rng.uniform(0, 5, (120, 2))
    frame = lambda a: spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(a)], "gid long, latitude double, longitude double")
    d = np.hypot(*(p[:, None] - q[None]).transpose(2, 0, 1))
    for bound in (0.2, 0.6):
        got = {r["sid"]: r["tid"] for r in neighbors.nn_join(frame(p), frame(q), bound).collect()}
        assert got == {k: int(d[k].argmin()) if d[k].min() < bound else None for k in range(len(p))}
    assert {r["sid"]: r["tid"] for r in neighbors.nearest(frame(p), frame(q), 0.05).collect()} == dict(enumerate(d.argmin(axis=1).tolist()))
    mapping = neighbors.inverse_map(neighbors.nn_join(frame(p), frame(q), 0.6))
    assert sum(len(r["sids"]) for r in mapping.collect()) == int((d.min(axis=1) < 0.6).sum())


def series(spark, seed, n_sites=3, shift=0.0, scale=1.0):
    rng = np.random.default_rng(seed)
    rows = [(g, 1420070400 + 86400 * k, float(scale * rng.lognormal() + shift)) for g in range(n_sites) for k in range(730)]
    return spark.createDataFrame(rows, "gid long, s long, x double").select("gid", F.timestamp_seconds("s").alias("time"), "x").cache()


def by_row(df):
    return {(r["gid"], r["time"]): r["x"] for r in df.collect()}


def test_quantile_mapping_identities(spark):
    a = series(spark, 1)
    same = bias.qdm_params(a, a, a, "x")
    for relative in (True, False):
        got = by_row(bias.apply_qdm(a, same, "x", relative=relative))
        want = by_row(a)
        assert max(abs(got[k] - want[k]) for k in want) < 1e-9
    plus = a.withColumn("x", F.col("x") + 10)
    offset = bias.qdm_params(plus, a, a, "x")
    got, want = by_row(bias.apply_qdm(a, offset, "x", relative=False)), by_row(a)
    assert max(abs(got[k] - want[k] - 10) for k in want) < 1e-6
    trend = bias.qdm_params(a, a, plus, "x")
    got, want = by_row(bias.apply_qdm(plus, trend, "x", relative=False)), by_row(plus)
    assert max(abs(got[k] - want[k]) for k in want) < 1e-6


def test_quantile_mapping_equals_numpy(spark):
    base, model, future = series(spark, 1, 1), series(spark, 2, 1, scale=2.0), series(spark, 3, 1, scale=2.5)
    params = bias.qdm_params(base, model, future, "x", 1, 800.0)
    row, q = params.first(), np.linspace(0, 1, 101)
    got = by_row(bias.apply_qdm(future, params, "x", 1))
    for (g, time), x in by_row(future).items():
        tau = np.interp(x, row["bias_fut"], q)
        assert got[g, time] == pytest.approx(np.interp(tau, q, row["base"]) * x / np.interp(tau, q, row["bias"]), rel=1e-6)


def test_presrat_keeps_dry_share_and_means(spark):
    dry = lambda df, c: df.withColumn("x", F.when(F.col("x") < c, 0.0).otherwise(F.col("x")))
    base, model = dry(series(spark, 1), 0.6).cache(), dry(series(spark, 2, scale=1.5), 0.4).cache()
    future = model.withColumn("x", F.col("x") * 1.2).cache()
    params = bias.presrat_params(base, model, future, "x", 0.01, 4, 180)
    checks = params.agg(F.min("k_factor"), F.min("tau_fut"), F.max("zero_rate"), F.count_if(F.isnan("k_factor"))).first()
    assert checks[0] > 0 and checks[1] >= 0 and 0 < checks[2] < 1 and checks[3] == 0
    done = bias.apply_presrat(future, params, "x", 0.01, 4)
    rates = {r["gid"]: r["z"] for r in done.groupBy("gid").agg(F.avg((F.col("x") == 0).cast("double")).alias("z")).collect()}
    want = {r["gid"]: r["z"] for r in base.groupBy("gid").agg(F.avg((F.col("x") == 0).cast("double")).alias("z")).collect()}
    assert all(abs(rates[g] - want[g]) < 0.05 for g in want)


def test_zero_rates(spark):
    df = spark.createDataFrame([(float(k),) for k in range(10)] + [(float("nan"),), (None,)], "x double")
    assert [df.agg(bias.zero_rate(F.col("x"), t).alias("z")).first()["z"] for t in (-1, 0, 9, 10)] == [0, 0.1, 1, 1]
    assert df.where("isnan(x)").agg(bias.zero_rate(F.col("x")).alias("z")).first()["z"] is None


def test_fill_and_smooth(spark):
    rows = [(i, j, 0, None if i == j else float(i + 10 * j)) for i in range(5) for j in range(5)]
    df = spark.createDataFrame(rows, "south_north int, west_east int, t_idx int, scalar double")
    done = bias.fill_and_smooth(df, ["scalar"], 5, 5)
    assert done.where("scalar is null").count() == 0 and done.count() == 25
    assert bias.fill_and_smooth(df, ["scalar"], 5, 5, smooth_extend=1.0).where("scalar is null").count() == 0


def test_gaussian_equals_direct(spark, cube, cube_array):
    got = windows.smooth(cube.select("south_north", "west_east", "t_idx", "u_10m"), "u_10m", 0.9, 6, 4, ("t_idx",))
    want = cube_array[..., 0]
    for axis, n in ((0, 6), (1, 4)):
        want = sum(w * np.take(want, np.clip(np.arange(n) + k, 0, n - 1), axis) for k, w in windows.gaussian_weights(0.9))
    assert np.allclose(as_array(got, "u_10m", (6, 4, 12)), want)


def test_derivative_equals_gradient(cube, cube_array):
    got = windows.derivative(cube, "u_10m", "t_idx", ("south_north", "west_east")).select("south_north", "west_east", "t_idx", F.col("u_10m_d_t_idx").alias("d"))
    assert np.allclose(as_array(got, "d", (6, 4, 12)), np.gradient(cube_array[..., 0], axis=2))


def test_linear_refinement(cube, cube_array):
    for s, t, centered in ((2, 3, True), (3, 1, False), (1, 4, False)):
        model = models.LinearModel(s, t, centered)
        want = model(cube_array[..., :1])[..., 0]
        got = grid.interpolate(cube, "u_10m", 6, 4, 12, s, t, centered)
        assert np.allclose(as_array(got, "u_10m", want.shape), want)
    line = models.LinearModel(2, 1)(np.array([0.0, 1.0, 2.0]).reshape(3, 1, 1, 1))[:, 0, 0, 0]
    assert line == pytest.approx([-0.25, 0.25, 0.75, 1.25, 1.75, 2.25])


def test_surface_model_keeps_coarse_means():
    rng = np.random.default_rng(0)
    fine = rng.uniform(0, 1500, (8, 8))
    coarse = fine.reshape(4, 2, 4, 2).mean(axis=(1, 3))
    cube = rng.uniform(10, 90, (4, 4, 3, 3))
    out = models.SurfaceModel(["temperature_2m", "relativehumidity_2m", "pressure_0m"], coarse, fine, (-1.0, -0.001))(cube)
    assert out.shape == (8, 8, 3, 3) and np.allclose(out.reshape(4, 2, 4, 2, 3, 3).mean(axis=(1, 3)), cube)
    flat = models.SurfaceModel(["temperature_2m"], coarse, fine)(np.full((4, 4, 1, 1), 20.0))[..., 0, 0]
    higher = fine - np.repeat(np.repeat(coarse, 2, 0), 2, 1)
    assert np.corrcoef(flat.ravel(), higher.ravel())[0, 1] < -0.8


def test_chunked_equals_whole(cube, cube_array):
    model = lambda c: (np.roll(c, 1, 0) + np.roll(c, -1, 0) + np.roll(c, 1, 1) + np.roll(c, -1, 1) + np.roll(c, 1, 2))[..., :1]
    padded = np.pad(cube_array, ((1, 1), (1, 1), (1, 1), (0, 0)), mode="reflect")
    want = model(padded)[1:-1, 1:-1, 1:-1, 0]
    got = chunks.forward_pass(cube, ["u_10m", "v_10m"], chunks.Layout((6, 4, 12), (4, 3, 5), (1, 1, 1)), model, ["y"])
    assert np.allclose(as_array(got, "y", (6, 4, 12)), want)
    fine = chunks.forward_pass(cube, ["u_10m"], chunks.Layout((6, 4, 12), (3, 4, 6), (2, 2, 2), (2, 2, 1)), models.LinearModel(2, 1), ["y"])
    inner = as_array(fine, "y", (12, 8, 12))[2:-2, 2:-2]
    assert np.allclose(inner, models.LinearModel(2, 1)(cube_array[..., :1])[2:-2, 2:-2, :, 0])
    skip = chunks.forward_pass(cube, ["u_10m"], chunks.Layout((6, 4, 12), (3, 4, 6)), lambda c: c, ["y"], cube.sparkSession.createDataFrame([(0,), (1,)], "chunk_id int"))
    assert {r["chunk_id"] for r in skip.select("chunk_id").distinct().collect()} == {2, 3}


def test_chunk_table(spark):
    layout = chunks.Layout((10, 10, 20), (4, 5, 8), (1, 0, 2), (2, 2, 3))
    rows = layout.frame(spark).collect()
    assert len(rows) == 3 * 2 * 3 and chunks.slices(10, 4) == [(0, 4), (4, 8), (8, 10)]
    for r in rows:
        assert r["i_mirror_before"] == (1 if r["i_from"] == 0 else 0) and r["t_mirror_behind"] == 2 - (r["t_pad_to"] - r["t_to"])
        assert r["i_fine_to"] - r["i_fine_from"] == r["i_crop_to"] - r["i_crop_from"] == 2 * (r["i_to"] - r["i_from"])


def test_losses(spark, cube_array):
    rng = np.random.default_rng(1)
    true, fake = rng.normal(size=(2, 4, 4, 5)), rng.normal(size=(2, 4, 4, 5))
    frame = lambda a: spark.createDataFrame([(o, i, j, t, float(a[o, i, j, t])) for o, i, j, t in np.ndindex(a.shape)], "obs int, south_north int, west_east int, t_idx int, x double")
    both, same = losses.pair(frame(true), frame(fake), ["x"]).cache(), losses.pair(frame(true), frame(true), ["x"])
    value = lambda df: df.first()["loss"]
    assert value(losses.mae(both, ["x"])) == pytest.approx(np.abs(true - fake).mean())
    assert value(losses.exp_loss(both, ["x"])) == pytest.approx((1 - np.exp(-((true - fake) ** 2))).mean())
    fft = [np.log1p(np.abs(np.fft.fftn(a, axes=(1, 2)))) for a in (true, fake)]
    assert value(losses.fft_loss(both, "x")) == pytest.approx(np.abs(fft[0] - fft[1]).mean())
    kernel = lambda a, b: np.exp(-((a.reshape(2, 1, -1) - b.reshape(1, 2, -1)) ** 2).sum(-1) / 2).mean()
    assert value(losses.mmd(both, "x")) == pytest.approx(kernel(true, true) + kernel(fake, fake) - 2 * kernel(true, fake))
    assert value(losses.low_res(both, ["x"], 2)) == pytest.approx(np.abs((true - fake).reshape(2, 2, 2, 2, 2, 5).mean(axis=(2, 4))).mean())
    for loss in (losses.mae, losses.coarse_mse, losses.spatial_extremes, losses.temporal_derivative):
        assert value(loss(same, ["x"])) == pytest.approx(0)
    assert value(losses.sliced_wasserstein(same, "x")) == pytest.approx(0) and value(losses.sliced_wasserstein(both, "x")) > 0
    one_by_one = {name: value(loss(both, ["x"])) for name, loss in losses.LOSSES.items()}
    assert {r["name"]: r["loss"] for r in losses.together(both, ["x"]).collect()} == pytest.approx(one_by_one)
    with pytest.raises(ValueError, match="no loss"):
        losses.together(both, ["x"], ["mae", "other"])
    assert value(losses.weighted(both, ["x"], {"mae": 2.0, "mse": 0.5})) == pytest.approx(2 * np.abs(true - fake).mean() + 0.5 * ((true - fake) ** 2).mean())


def test_spectra_equal_numpy(cube, cube_array):
    flat = cube_array[..., 0].reshape(-1, 12)
    energy = (np.abs(np.fft.fftn(flat)) ** 2).mean(axis=0) * np.arange(12.0) ** 2
    want = energy[:6] + energy[6:][::-1]
    got = qa.frequency_spectrum(cube.withColumn("k", F.lit(0)), ["u_10m"], ["k"]).orderBy("frequency").collect()
    assert np.allclose([r["energy"] for r in got], want)


def test_sampling(cube):
    low = coarsen.spatial(cube, ["u_10m"], 2, by=("t_idx",))
    a, b = sampling.pair_samples(low, cube, 1, 0, 2, (1, 2, 3), 2, 1)
    assert (a.count(), b.count()) == (6, 24)
    queue = sampling.BatchQueue([(cube, 6, 4, 12)], ["u_10m"], (4, 4, 6), s=2, t=2, batch_size=3, n_batches=2, time_weights=[0, 0, 1])
    for coarse, fine in queue:
        assert fine.count() == 3 * 4 * 4 * 6 and coarse.count() == 3 * 2 * 2 * 3
    assert all(queue.draw()[3] in range(5, 7) for _ in range(30))
    assert [len(b) for b in sampling.bins_of(10, 4)] == [3, 3, 2, 2]
    pairs = {sampling.validation_bins(k, 4, 2) for k in range(8)}
    assert len(pairs) == 8
    share = sampling.observed(cube, ["u_10m"], 0.5, 3).agg((F.count("u_10m_obs") / F.count("*")).alias("s")).first()["s"]
    assert 0.2 < share < 0.8


def test_solar(spark):
    df = spark.createDataFrame([(0.5, 800.0, 900.0, 30.0, 900.0, 0.0), (1.0, 800.0, 900.0, 30.0, 900.0, 0.0), (0.5, 0.0, 0.0, 100.0, 900.0, 0.0), (1.0, 800.0, 900.0, 30.0, 900.0, 9.0)],
                               "clearsky_ratio double, clearsky_ghi double, clearsky_dni double, solar_zenith_angle double, surface_pressure double, distance double").withColumn("time", F.lit("2024-06-01 18:00:00").cast("timestamp"))
    got = [tuple(round(x, 6) for x in r) for r in solar.irradiance(df, 1.0).select("ghi", "dni", "dhi").collect()]
    assert got[0][0] == 400 and 0 < got[0][1] < 300 and got[0][2] == pytest.approx(400 - got[0][1] * math.cos(math.radians(30)), abs=1e-4)
    assert got[1] == (800, 900, pytest.approx(800 - 900 * math.cos(math.radians(30)), abs=1e-4)) and got[2] == got[3] == (0, 0, 0)
    noon = spark.createDataFrame([("2024-06-21 12:00:00", 23.44, 0.0), ("2024-06-21 00:00:00", 23.44, 0.0)], "t string, a double, o double")
    high, deep = (r["z"] for r in noon.select(scalars.solar_zenith(F.to_timestamp("t"), F.col("a"), F.col("o")).alias("z")).collect())
    assert high < 1 and deep > 89
    with pytest.raises(ValueError):
        solar.require(noon)


def test_skill_and_ks(spark):
    a, b = series(spark, 1, 1), series(spark, 5, 1, shift=0.3)
    row = bias.skill_assessment(a, b, "x").first()
    x, y = (np.array(sorted(by_row(d).values())) for d in (a, b))
    x, y = x - x.mean(), y - y.mean()
    grid_ = np.concatenate([x, y])
    want = np.abs(np.searchsorted(np.sort(x), grid_, "right") / len(x) - np.searchsorted(np.sort(y), grid_, "right") / len(y)).max()
    assert row["ks"] == pytest.approx(want, abs=2e-3) and 0 <= row["ks_p"] <= 1


def test_pooled_statistics(cube, cube_array):
    two = cube.withColumn("container_id", F.lit(0)).unionByName(cube.withColumn("container_id", F.lit(1)))
    got = stats.pooled(two, ["u_10m"]).first()
    assert (got["mean"], got["std"]) == pytest.approx((cube_array[..., 0].mean(), cube_array[..., 0].std()))
    means, stds = {"u_10m": 1.0}, {"u_10m": 4.0}
    back = stats.unnormalize(stats.normalize(cube, means, stds), means, stds)
    assert back.join(cube.select("south_north", "west_east", "t_idx", F.col("u_10m").alias("x")), ["south_north", "west_east", "t_idx"]).where(F.abs(F.col("x") - F.col("u_10m")) > 1e-12).count() == 0


def test_handler_cache_and_round_trip(spark, cube, tmp_path):
    source = str(tmp_path / "cube.parquet")
    cube.drop("t_idx").write.parquet(source)
    handler = Handler(features=["windspeed_10m", "u_10m"], target=(45.0, -100.0), shape=(4, 4), times=(0, 8, 2), coarsen_by=2, gaps="mask")
    first = handler.from_files(spark, source, cache=str(tmp_path / "cache_{feature}"))
    assert first.count() == 2 * 2 * 4 and scan.cached(spark, str(tmp_path / "cache_{feature}"), ["u_10m", "x"]) == (["u_10m"], ["x"])
    assert handler.from_files(spark, source, cache=str(tmp_path / "cache_{feature}")).count() == first.count()
    day, hours = daily_pair(cube, ["u_10m"])
    assert day.count() == 24 and hours is cube
    out = str(tmp_path / "out.parquet")
    sinks.write_output(cube.withColumnRenamed("u_10m", "clearsky_ratio"), out, ["clearsky_ratio"])
    read = spark.read.parquet(out)
    assert read.agg(F.max("clearsky_ratio")).first()[0] <= 1 and read.schema["clearsky_ratio"].metadata["units"] == "ratio"
    sinks.save_stats(stats.mean_std(cube, ["u_10m"]), str(tmp_path / "stats"))
    assert set(sinks.load_stats(spark, str(tmp_path / "stats"))[0]) == {"u_10m"}


def test_scan_errors_and_names(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        scan.expand(str(tmp_path / "*.none"))
    with pytest.raises(ValueError):
        scan.source_type(["a.parquet", "b.csv"])
    spark.createDataFrame([(1.0, 190.0, float("nan"), 300.0)], "LAT double, lon double, HGT double, Tas double").write.parquet(str(tmp_path / "a.parquet"))
    row = scan.scan(spark, str(tmp_path / "a.parquet"), units={"tas": "K"}).first()
    assert row.asDict() == {"latitude": 1.0, "longitude": -170.0, "topography": None, "tas": pytest.approx(26.85)}
    scan.register("tiny", lambda s, p: s.range(3).toDF("gid"))
    assert scan.scan(spark, "x.tiny").count() == 3


def test_collect(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0)], "gid long, time long, u double")
    b = spark.createDataFrame([(1, 0, 2.0), (2, 0, 3.0)], "gid long, time long, u double")
    assert collect.combine([a, b]).count() == 3 and collect.duplicate_steps(a.unionByName(b)).count() == 1
    assert collect.merge_features([a, b.withColumnRenamed("u", "v")]).where("u is null or v is null").count() == 2
    uv = spark.createDataFrame([(3.0, 4.0)], "u_10m double, v_10m double")
    assert collect.to_speed_direction(uv, [("u_10m", "v_10m")]).first()["windspeed_10m"] == 5.0


def test_commands(spark, tmp_path):
    paths = {k: str(tmp_path / f"{k}.parquet") for k in ("base", "bias", "factors", "out")}
    series(spark, 1).write.parquet(paths["base"])
    series(spark, 2, shift=1.0).write.parquet(paths["bias"])
    steps = [
        {"command": "bias-calc", "base": paths["base"], "bias_source": paths["bias"], "feature": "x", "out": str(tmp_path / "{method}.parquet"), "sweep": {"method": ["linear", "monthly"]}},
        {"command": "bias-apply", "source": paths["bias"], "factors": str(tmp_path / "linear.parquet"), "features": ["x"], "out": paths["out"]},
    ]
    cli.run(spark, json.loads(json.dumps(steps)))
    got, want = (spark.read.parquet(p).agg(F.avg("x")).first()[0] for p in (paths["out"], paths["base"]))
    assert got == pytest.approx(want) and spark.read.parquet(str(tmp_path / "monthly.parquet")).count() == 36
    with pytest.raises(ValueError):
        cli.run(spark, [{"command": "nothing"}])


def test_stream(spark, tmp_path):
    from gridloom.streaming.daily import stream_daily

    source = str(tmp_path / "in")
    rows = [(g, f"2024-01-0{d} {h:02d}:00:00", float(h + d)) for g in (1, 2) for d in (1, 2, 5) for h in range(0, 24, 6)]
    spark.createDataFrame(rows, "gid long, t string, x double").select("gid", F.to_timestamp("t").alias("time"), "x").repartition(1).write.parquet(source)
    stream = stream_daily(spark.readStream.schema("gid long, time timestamp, x double").parquet(source), ["x"])
    query = stream.writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["gid"], str(r["day"])[:10]): r["x"] for r in spark.table("days").collect()}
    assert got == {(g, f"2024-01-0{d}"): 9.0 + d for g in (1, 2) for d in (1, 2)}


def test_pair_of_members(spark, cube):
    low = coarsen.spatial(cube, ["u_10m", "latitude", "longitude"], 2, by=("time",))
    from gridloom.plans import pairs

    done = pairs.pair(low, cube, ["u_10m"], 6, 4, 2, 1, k=1, bound=0.5)
    same = done.low.alias("a").join(low.alias("b"), ["south_north", "west_east", "time"]).where(F.abs(F.col("a.u_10m") - F.col("b.u_10m")) < 1e-9)
    assert same.count() == low.count() and done.high.count() == cube.count()
    with pytest.raises(ValueError):
        pairs.check_steps(low, cube, 4)
    with pytest.raises(ValueError):
        pairs.pair(low.withColumn("u_10m", F.when(F.col("south_north") > 0, F.col("u_10m"))), cube, ["u_10m"], 6, 4, 2, 1, regrid=False)


def test_exogenous_steps(spark, cube):
    from gridloom.plans import pairs

    steps = pairs.exo_steps("topography", [(0, "input"), (0, "layer"), (1, "input"), (1, "output")], [2, 3], [1, 4])
    assert [(s.s_enhance, s.t_enhance) for s in steps] == [(1, 1), (2, 1), (2, 1), (6, 4)]
    assert len(pairs.steps_of(steps, 1, "output")) == 1 and [s.model for s in pairs.split_steps(steps, 1)[1]] == [0, 0]
    target = grid.flatten(cube.select("south_north", "west_east", "latitude", "longitude").distinct(), 4)
    source = target.where("gid % 5 > 0").select("gid", "latitude", "longitude", (F.col("gid") * 1.0).alias("topography"))
    field = pairs.exo_field(source, target, "topography", 0.5, 2.0, cube.select("time").distinct())
    assert field.count() == 24 * 12 and field.where("topography is null").count() == 0
    assert field.where("gid % 5 > 0 and topography != 2 * gid").count() == 0


def test_downscaling_plan(spark, cube):
    from gridloom.plans.downscale import Downscaling

    layout = chunks.Layout((6, 4, 12), (3, 4, 6), (1, 1, 1), (2, 2, 1))
    mask = cube.select("south_north", "west_east", (F.col("south_north") >= 2).alias("mask")).distinct()
    plan = Downscaling(models.LinearModel(2, 1), layout, ["u_10m", "v_10m"], ["u_10m", "v_10m"], mask=mask, wind=[("u_10m", "v_10m")])
    out = plan.run(cube, spark.createDataFrame([(1,)], "chunk_id int"))
    assert {r["chunk_id"] for r in out.select("chunk_id").distinct().collect()} == {0}
    assert out.count() == 6 * 8 * 6 and out.where("windspeed_10m < 0 or winddirection_10m >= 360").count() == 0
    cells = cube.select("south_north", "west_east", "latitude", "longitude").distinct()
    assert plan.place(out, cells).select("gid").distinct().count() == 48
    with pytest.raises(ValueError):
        plan.run(cube.withColumn("u_10m", F.when(F.col("t_idx") > 0, F.col("u_10m"))))


def test_blocks_that_are_cut_off(spark):
    from gridloom.operators import coarsen

    rows = [(i, j, t, 1.0) for i in range(3) for j in range(2) for t in range(7)]
    df = spark.createDataFrame(rows, "south_north int, west_east int, t_idx int, x double")
    with pytest.raises(Exception, match="blocks of 4"):
        coarsen.temporal(df, ["x"], 4).collect()
    dropped = coarsen.temporal(df, ["x"], 4, "total", rest="drop").collect()
    assert {(r["t_block"], r["x"]) for r in dropped} == {(0, 4.0)} and len(dropped) == 6
    with pytest.raises(Exception, match="blocks of 2"):
        coarsen.spatial(df, ["x"], 2, by=("t_idx",)).collect()
    assert coarsen.spatial(coarsen.trim(df, 3, 2, 2), ["x"], 2, by=("t_idx",)).count() == 7


def test_nearest_at_any_distance(spark):
    from gridloom.operators.neighbors import nearest

    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 80.0, 170.0), (3, None, 1.0)], "gid int, latitude double, longitude double")
    target = spark.createDataFrame([(7, 0.0, 1e-7), (8, 1.0, 1.0)], "gid int, latitude double, longitude double")
    for width in (1e-6, None):
        assert {r["sid"]: r["tid"] for r in nearest(points, target, width).collect()} == {1: 7, 2: 8, 3: None}
    assert {(r["sid"], r["tid"], r["distance"]) for r in nearest(points, target.limit(0)).collect()} == {(k, None, None) for k in (1, 2, 3)}


def test_rotation_of_rising_latitudes(spark):
    from gridloom.operators.windows import rotation

    cells = [(i, j, 30.0 + 0.5 * i * i, -100.0 + j + 0.1 * i) for i in range(4) for j in range(2)]
    up = spark.createDataFrame(cells, "south_north int, west_east int, latitude double, longitude double")
    down = spark.createDataFrame([(3 - i, *rest) for i, *rest in cells], "south_north int, west_east int, latitude double, longitude double")
    angles = lambda df: {(r["latitude"], r["longitude"]): round(r["theta"], 12) for r in rotation(df).collect()}
    assert angles(up) == angles(down) and len(set(angles(up).values())) > 1


def test_presrat_keeps_the_modelled_change_of_the_mean(spark):
    """K of one site and window against plain sums: the corrected future counts with its drizzle."""
    import datetime

    from gridloom.operators import bias

    rng = np.random.default_rng(4)
    day = lambda k: datetime.datetime(2001, 1, 1) + datetime.timedelta(days=int(k))
    series = {name: np.where(rng.random(365) < dry, 0.2, rng.gamma(2.0, scale, 365)) for name, dry, scale in (("oh", 0.5, 3.0), ("mh", 0.2, 4.0), ("mf", 0.2, 6.0))}
    frames = [spark.createDataFrame([(1, day(k), float(v)) for k, v in enumerate(x)], "gid int, time timestamp, x double") for x in series.values()]
    row = bias.presrat_params(*frames, "x", threshold=1.0, n=1, days=730).first()
    levels = np.linspace(0, 1, 101)
    q = {k: np.quantile(v, levels) for k, v in series.items()}
    tau = np.interp(series["mf"], q["mf"], levels)
    corrected = np.interp(tau, levels, q["oh"]) * series["mf"] / np.maximum(np.interp(tau, levels, q["mh"]), 1.0)
    k = (series["mf"].mean() / series["mh"].mean()) / (corrected.mean() / series["oh"].mean())
    rate = (series["oh"] <= 1).mean()
    cut = np.sort(series["mh"])[min(round(rate * 365), 364)]
    want = np.sort(corrected)[min(round((series["mf"] < cut).mean() * 365), 364)]
    assert abs(row["k_factor"] - k) < 0.02 * k and abs(row["tau_fut"] - want) < 0.05 * want and abs(row["zero_rate"] - rate) < 1e-9


def test_split_evenly_over_many_ranges(spark):
    from gridloom.operators.grid import split_evenly

    rows = split_evenly(spark.range(1000).selectExpr("(id * 7919) % 1000 as v"), "v", 7).orderBy("v").collect()
    sizes = [sum(r["group"] == g for r in rows) for g in range(7)]
    assert sizes == [143] * 6 + [142] and [r["group"] for r in rows] == sorted(r["group"] for r in rows)


def test_daily_ratio_is_one_of_sums(spark):
    rows = [(1, f"2020-01-0{1 + k // 2} 0{k % 2}:00:00", ghi, clear, ghi) for k, (ghi, clear) in enumerate([(1.0, 4.0), (5.0, 8.0), (0.0, 0.0), (0.0, 0.0)])]
    df = spark.createDataFrame(rows, "gid int, time string, ghi double, clearsky_ghi double, clearsky_ratio double").withColumn("time", F.to_timestamp("time"))
    assert [r["clearsky_ratio"] for r in coarsen.reduce_daily(df, "clearsky_ratio", "avg").orderBy("date").collect()] == [0.5, 0.0]
    halves = coarsen.reduce_daily(df.withColumn("x", F.when(F.hour("time") == 0, 0.25).otherwise(0.0)), "x", "avg", decimals=2)
    assert {r["x"] for r in halves.collect()} == {0.12}


def test_times_tell_their_range(spark):
    days = lambda *texts: spark.createDataFrame([(d,) for d in texts], "time string").withColumn("time", F.to_timestamp("time"))
    full = T.range_of(days("2020-02-27", "2020-02-28", "2020-02-29", "2020-03-01"))
    assert full == {"start": "2020-02-27 00:00:00", "end": "2020-03-01 00:00:00", "step": "86400 second", "drop_leap": False}
    dropped = T.range_of(days("2020-02-27", "2020-02-28", "2020-03-01"))
    assert dropped["drop_leap"] and T.time_range(spark, **dropped).count() == 3
    for texts in (("2020-01-01", "2020-01-02", "2020-01-05"), ("2021-02-27", "2021-02-28", "2021-03-02"), ()):
        with pytest.raises(ValueError):
            T.range_of(days(*texts))


def test_solar_needs_hours(spark):
    hours = spark.range(5).select(F.timestamp_seconds(F.col("id") * 3600).alias("time"))
    solar.require_hourly(hours)
    with pytest.raises(ValueError):
        solar.require_hourly(hours.where(F.hour("time") % 2 == 0))


def test_low_resolution_loss_in_time(spark):
    true, fake = np.random.default_rng(3).normal(size=(2, 2, 4, 4, 6))
    rows = [(o, i, j, k, float(true[o, i, j, k]), float(fake[o, i, j, k])) for o in range(2) for i in range(4) for j in range(4) for k in range(6)]
    both = spark.createDataFrame(rows, "obs int, south_north int, west_east int, t_idx int, x double, x_hat double")
    apart = (true - fake).reshape(2, 2, 2, 2, 2, 2, 3).mean(axis=(2, 4, 6))
    assert losses.low_res(both, ["x"], 2, t=3).first()["loss"] == pytest.approx(np.abs(apart).mean())
    both_losses = losses.low_res(both, ["x"], 2, losses.mse, t=3, extremes=losses.mae).first()["loss"]
    assert both_losses == pytest.approx((apart**2).mean() + np.abs(apart).mean())


def test_sites_keep_their_rows(spark):
    meta = spark.createDataFrame([(g,) for g in (10, 20, 30, 40)], "gid int")
    chunk = lambda *gids: spark.createDataFrame([(g, 1.0) for g in gids], "gid int, x double")
    assert {r["gid"]: r["row"] for r in collect.place(chunk(20, 30, 30, 99), meta).collect()} == {20: 1, 30: 2}
    assert collect.place(chunk(99), meta).count() == 0
    with pytest.raises(ValueError):
        collect.place(chunk(10, 30), meta)


def test_group_mean_at_given_times(spark):
    source = spark.createDataFrame([(1, 0.0, 0.0, "2020-01-01", 1.0), (2, 0.1, 0.0, "2020-01-01", 3.0), (1, 0.0, 0.0, "2020-01-02", 9.0)], "gid int, latitude double, longitude double, time string, x double")
    target = spark.createDataFrame([(7, 0.0, 0.0)], "gid int, latitude double, longitude double")
    times = spark.createDataFrame([("2020-01-01",), ("2020-01-03",)], "time string")
    assert {r["time"]: r["x"] for r in neighbors.group_mean(source, target, ["x"], 1.0, True, times).collect()} == {"2020-01-01": 2.0, "2020-01-03": None}


def test_factors_of_the_nearest_place(spark, tmp_path):
    factors = spark.createDataFrame([(1, 0.0, 0.0, 2.0), (2, 5.0, 5.0, 3.0)], "gid int, latitude double, longitude double, x_scalar double")
    factors.write.parquet(str(tmp_path / "f"))
    cells = lambda *at: spark.createDataFrame([(50 + k, a, b) for k, (a, b) in enumerate(at)], "gid int, latitude double, longitude double")
    got = scan.bias_factors(spark, str(tmp_path / "f"), ["x_scalar"], cells=cells((5.05, 5.0), (0.0, 0.02)))
    assert {r["gid"]: r["x_scalar"] for r in got.collect()} == {50: 3.0, 51: 2.0}
    with pytest.raises(ValueError):
        scan.bias_factors(spark, str(tmp_path / "f"), ["x_scalar"], cells=cells((1.0, 0.0)))
    with pytest.raises(KeyError):
        scan.bias_factors(spark, str(tmp_path / "f"), ["x_adder"])


def test_recoarsened_shapes_must_fit(spark, cube):
    coarse = coarsen.temporal(coarsen.spatial(cube, ["u_10m"], 2, by=("t_idx",)), ["u_10m"], 3).withColumnRenamed("t_block", "t_idx")
    assert qa.recoarsen_error(cube, coarse, ["u_10m"], 2, 3).agg(F.max(F.abs("u_10m_error")).alias("e")).first()["e"] < 1e-12
    for wrong in (coarse.where("t_idx < 2"), coarse.unionByName(coarse.withColumn("t_idx", F.col("t_idx") + 9))):
        with pytest.raises(Exception, match="differ in shape"):
            qa.recoarsen_error(cube, wrong, ["u_10m"], 2, 3).collect()


def test_strict_levels_and_reanalysis_columns(spark):
    from gridloom.operators.standardize import standardize

    profile = spark.createDataFrame([(1, 10.0, 1.0), (1, 20.0, 2.0), (2, None, 5.0)], "k int, lev double, v double")
    assert profiles.interpolate(profile.where("k = 1"), "v", 15.0, keys=("k",), strict=True).first()["v"] == 1.5
    with pytest.raises(Exception, match="no value at level"):
        profiles.interpolate(profile, "v", 15.0, keys=("k",), strict=True).collect()
    assert standardize(spark.createDataFrame([(1, 2, 3.0)], "expver int, number int, u_10m double")).columns == ["u_10m"]


def test_stored_values_come_back(spark):
    from gridloom.operators.standardize import unscale

    df = spark.createDataFrame([(0.125, 1.5), (300.0, 2.5), (None, None)], "windspeed_10m double, other double")
    whole = sinks.stored(df, ["windspeed_10m", "other"])
    assert [tuple(r) for r in whole.collect()] == [(12, 1.5), (12000, 2.5), (None, None)] and whole.schema["windspeed_10m"].dataType.typeName() == "integer"
    back = unscale(whole, {"windspeed_10m": whole.schema["windspeed_10m"].metadata["scale_factor"]})
    assert [r["windspeed_10m"] for r in back.collect()] == [0.12, 120.0, None]


def test_levels_denser_at_one_end():
    low, high = bias.quantile_levels(11, "log"), bias.quantile_levels(11, "invlog")
    assert low[0] == high[0] == 0.0 and low[-1] == pytest.approx(1.0) and high[-1] == 1.0
    assert np.all(np.diff(low, 2) > 0) and np.all(np.diff(high, 2) < 0)


def test_qa_command_corrects_the_source(spark, tmp_path):
    fine = spark.createDataFrame([(i, j, t, 3.0) for i in range(2) for j in range(2) for t in range(2)], "south_north int, west_east int, t_idx int, x double")
    source = spark.createDataFrame([(0, 0, 0, 5, 1.0)], "south_north int, west_east int, t_idx int, gid int, x double").withColumn("time", F.to_timestamp(F.lit("2020-01-01")))
    factors = bias.linear_factors(spark.createDataFrame([(5, 2.0), (5, 6.0)], "gid int, x double"), spark.createDataFrame([(5, 1.0), (5, 3.0)], "gid int, x double"), "x")
    paths = {name: str(tmp_path / name) for name in ("fine", "source", "factors", "out")}
    for name, df in (("fine", fine), ("source", source), ("factors", factors)):
        df.write.parquet(paths[name])
    cli.run(spark, [{"command": "qa", **{k: paths[k] for k in ("fine", "source", "factors", "out")}, "features": ["x"], "s": 2, "t": 2, "bias_method": "linear"}])
    row = spark.read.parquet(paths["out"]).first()
    assert (row["x_synthetic"], row["x_true"], row["x_error"]) == (3.0, 2.0, 1.0)


def test_places_at_one_distance_go_by_their_ids(spark):
    """The middle of four places: in binary the differences of its coordinates to theirs are not the same."""
    from decimal import Decimal

    from gridloom.cubes import placed

    k = spark.range(1).select(placed("-105.2", "0.00087", F.lit(3)).alias("x")).first()["x"]
    assert k == Decimal("-105.19739")
    point = spark.createDataFrame([(1, Decimal("39.95000"), Decimal("-104.95000"))], "gid int, latitude decimal(14,5), longitude decimal(14,5)")
    around = [(i, Decimal(40) - Decimal("0.1") * (i // 2), Decimal(-105) + Decimal("0.1") * (i % 2)) for i in range(4)]
    corners = spark.createDataFrame(around, "gid int, latitude decimal(14,5), longitude decimal(14,5)")
    got = {r["rank"]: (r["tid"], r["distance"]) for r in neighbors.knn_join(point, corners, 4, 0.2).collect()}
    assert got == {i + 1: (i, (0.05 * 0.05 + 0.05 * 0.05) ** 0.5) for i in range(4)}


def test_window_quantiles_of_three_histories_take_one_exchange(spark):
    """All rows are dealt out by site once; sites or windows that a history lacks, nulls and repeated values change nothing of it."""
    import datetime as dt

    rng = np.random.default_rng(4)
    when = lambda k: dt.datetime(2001, 1, 1) + dt.timedelta(days=int(k))
    series = [[(g, when(d), float(rng.integers(0, 6))) for g in sites for d in rng.integers(0, 365, 80)] + [(sites[0], when(3), None)] for sites in ((1, 2, 3), (2, 1), (1, 2, 4))]
    series[2] += [(5, when(9), None)]
    frames = [spark.createDataFrame(rows, "gid long, time timestamp, x double") for rows in series]
    params = bias.qdm_params(*frames, "x", 4, 120, [0.0, 0.3, 1.0])
    assert params._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    days = {}
    for r in bias.window_days(spark, 4, 120).collect():
        days.setdefault(r["t_window"], set()).add(r["doy"])
    of = lambda rows, g, w: [x for gid, t, x in rows if gid == g and x is not None and t.timetuple().tm_yday in days[w]]
    got = {(r["gid"], r["t_window"]): (r["base"], r["bias"], r["bias_fut"]) for r in params.collect()}
    assert got.keys() == {(g, w) for g in (1, 2) for w in range(4)}
    for (g, w), lists in got.items():
        for rows, found in zip(series, lists, strict=True):
            assert np.allclose(found, np.quantile(of(rows, g, w), [0.0, 0.3, 1.0]))
    means = bias._means(dict(zip("abc", frames, strict=True)), "x", 4, 120)
    for r in means.where("gid in (1, 2)").collect():
        assert np.allclose([r[c] for c in "abc"], [np.mean(of(rows, r["gid"], r["t_window"])) for rows in series])
