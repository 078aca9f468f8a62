"""Exogenous chunks, chains of models, and the command that runs them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import chunks, models
from gridloom.operators.observations import Coverage, observed
from gridloom.plans import cli
from gridloom.plans.pairs import exo_steps


def grid(spark, rows, columns, steps=None):
    df = spark.range(rows * columns).select((F.col("id") / columns).cast("int").alias("south_north"), (F.col("id") % columns).cast("int").alias("west_east"))
    return df if steps is None else df.crossJoin(spark.range(steps).select(F.col("id").cast("int").alias("t_idx")))


def test_ranges_of_a_chunk_follow_from_its_id():
    layout = chunks.Layout((7, 5, 9), (3, 2, 4), (1, 1, 2), (2, 2, 3))
    for row in layout.table():
        assert layout.spans(row[0]) == [row[3:5], row[13:15], row[23:25]]
    fine = layout.refined(2, 3)
    assert layout.counts() == fine.counts() == (3, 3, 3) and [max(p for p, _, _ in fine.places(a)) for a in range(3)] == [13, 9, 26]


def test_a_narrow_last_chunk_gets_more_overlap():
    layout = chunks.Layout((8, 8, 8), (7, 4, 8), (1, 1, 0), (2, 2, 1), (4, 4, 4))
    assert [layout.pad_of(0, c) for c in (0, 1)] == [1, 3] and layout.pad_of(1, 1) == 1 and layout.pads(3) == [3, 1, 0]
    assert [p for p, c, _ in layout.places(0) if c == 1] == [4, 5, 6, 7, 6, 5, 4]  # 7 and three on both sides
    assert [p for p, c, _ in layout.refined(2, 1).places(0) if c == 1] == [8, 9, 10, 11, 12, 13, 14, 15, 14, 13, 12, 11, 10, 9]


def test_narrow_chunks_in_a_forward_pass(spark):
    cube = grid(spark, 7, 4, 5).withColumn("u", F.col("south_north") * 100.0 + F.col("west_east") * 10 + F.col("t_idx"))
    got = chunks.forward_pass(cube, ["u"], chunks.Layout((7, 4, 5), (3, 3, 5), (0, 0, 0), (2, 2, 1), (3, 3, 0)), lambda x: np.repeat(np.repeat(x, 2, 0), 2, 1), ["u"]).collect()
    assert len(got) == 14 * 8 * 5 and all(r["u"] == r["south_north"] // 2 * 100 + r["west_east"] // 2 * 10 + r["t_idx"] for r in got)


@pytest.mark.parametrize("moving", [False, True])
def test_a_chunk_gets_the_exogenous_cells_of_its_padded_range(spark, moving):
    cube = grid(spark, 5, 4, 6).withColumn("u", F.col("south_north") * 1000 + F.col("west_east") * 100 + F.col("t_idx") * 1.0)
    (step,) = exo_steps("h", [(0, "layer")], [3], [2])
    fine = grid(spark, 15, 12, 12 if moving else None).withColumn("h", F.col("south_north") * 1000.0 + F.col("west_east") * 10 + (F.col("t_idx") / 100 if moving else 0))
    layout = chunks.Layout((5, 4, 6), (2, 3, 4), (1, 1, 1), (3, 3, 2))

    def model(cube, exo):
        (e,) = exo
        fine_u = np.repeat(np.repeat(np.repeat(cube[..., 0], 3, 0), 3, 1), 2, 2)
        h = e.values if e.values.ndim == 3 else e.values[..., None]
        assert e.values.shape[:2] == fine_u.shape[:2] and not np.isnan(e.values).any()
        return np.stack([fine_u, np.broadcast_to(h, fine_u.shape)], -1)

    got = chunks.forward_pass(cube, ["u"], layout, model, ["u", "h"], exo=[(step, fine)]).collect()
    assert len(got) == 15 * 12 * 12
    for r in got:
        i, j, t = r["south_north"], r["west_east"], r["t_idx"]
        assert r["u"] == (i // 3) * 1000 + (j // 3) * 100 + t // 2 and r["h"] == pytest.approx(i * 1000 + j * 10 + (t / 100 if moving else 0))
    skip = spark.createDataFrame([(0,), (3,)], "chunk_id int")
    left = chunks.forward_pass(cube, ["u"], layout, model, ["u", "h"], skip, [(step, fine)])
    assert {r[0] for r in left.select("chunk_id").distinct().collect()} == set(range(12)) - {0, 3}


def test_a_chain_matches_features_by_name_and_tells_what_lacks():
    double = lambda x: np.repeat(np.repeat(x[..., ::-1], 2, 1), 2, 2)  # noqa: E731  swaps its two features
    steps = [models.Step(double, ("v", "u"), ("u", "v"), 2, 1, True), models.Step(lambda x, layers: x[..., :1] - x[..., 1:] + layers["h"][..., None], ("v", "u"), ("d",))]
    exo = exo_steps("h", [(1, "layer")], [2, 1], [1, 1])
    chain = models.Chain(steps, inputs=["u", "v"], exo=exo)
    cube = np.stack([np.full((3, 2, 4), 5.0), np.full((3, 2, 4), 8.0)], -1)
    out = chain(cube, [chunks.ExoSlice("h", 1, "layer", np.full((6, 4), 0.5))])
    # (v, u) = (8, 5) come out swapped as u = 5, v = 8
    assert out.shape == (6, 4, 4, 1) and (out == 3.5).all() and (chain.s_enhance, chain.t_enhance, chain.outputs) == (2, 1, ["d"])
    with pytest.raises(ValueError, match="nothing gives"):
        models.Chain([steps[0], models.Step(double, ("w",), ("x",))], inputs=["u", "v"])
    with pytest.raises(ValueError, match="is due"):
        chain(cube, [chunks.ExoSlice("h", 1, "layer", np.zeros((3, 2)))])
    with pytest.raises(ValueError, match="model 0 gave"):
        models.Chain([models.Step(lambda x: x, ("u",), ("u",), 2)])(cube[..., :1])


def test_two_linear_steps_are_one_in_time():
    cube = np.random.default_rng(1).normal(size=(2, 2, 6, 1))
    two = models.Chain([models.Step(models.LinearModel(1, 2), ("u",), ("u",), 1, 2), models.Step(models.LinearModel(1, 3), ("u",), ("u",), 1, 3)])
    assert np.allclose(two(cube)[:, :, :-6], models.LinearModel(1, 6)(cube)[:, :, :-6])


def test_models_by_name():
    models.register_model("twice", lambda s_enhance=1: lambda x: np.repeat(np.repeat(x, s_enhance, 0), s_enhance, 1))
    chain = models.chain_of([{"model": "linear", "s_enhance": 2, "t_enhance": 1, "inputs": ["u"]}])
    assert chain(np.ones((2, 2, 3, 1))).shape == (4, 4, 3, 1) and callable(models.model_by_name("twice", s_enhance=2))
    with pytest.raises(ValueError, match="known"):
        models.model_by_name("thrice")


class AddHeight:
    """Doubles the grid and adds the height of the fine cells."""

    s_enhance, t_enhance = 2, 1

    def __init__(self, s_enhance=2):
        self.s_enhance = s_enhance

    def __call__(self, x, layers):
        return np.repeat(np.repeat(x, 2, 0), 2, 1) + layers["topography"][..., None]


def test_the_forward_pass_command(spark, tmp_path):
    models.register_model("add-height", AddHeight)
    cube = grid(spark, 4, 4, 3).withColumns({"latitude": 40 - 0.5 * F.col("south_north"), "longitude": -105 + 0.5 * F.col("west_east"), "time": F.timestamp_seconds(F.col("t_idx") * 3600), "temperature_2m": F.col("t_idx") * 1.0}).drop("t_idx")
    cube.write.parquet(str(tmp_path / "cube"))
    points = spark.range(400).select(F.col("id").alias("gid"), (40.3 - F.floor(F.col("id") / 20) * 0.11).alias("latitude"), (-105.3 + (F.col("id") % 20) * 0.11).alias("longitude"), F.lit(7.0).alias("topography"))
    points.write.parquet(str(tmp_path / "points"))
    config = {
        "command": "forward-pass", "source": str(tmp_path / "cube"), "out": str(tmp_path / "out"), "chunk": [2, 3, 2], "pad": [1, 1, 0],
        "models": [{"model": "add-height", "s_enhance": 2, "inputs": ["temperature_2m"]}],
        "exogenous": {"topography": {"source": str(tmp_path / "points"), "steps": [[0, "layer"]], "bound": 0.5}},
    }
    cli.run(spark, [config])
    done = spark.read.parquet(str(tmp_path / "out"))
    assert done.count() == 8 * 8 * 3 and {(r["t_idx"], r["temperature_2m"]) for r in done.collect()} == {(t, t + 7.0) for t in range(3)}
    cli.run(spark, [config])  # all chunks are there
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8 * 8 * 3


def test_whole_days_mirrors_what_a_model_lacks():
    cube = np.arange(5.0).reshape(1, 1, 5, 1)
    inner = lambda x: np.repeat(x[:, :, 1:-1], 4, 2) + np.tile(np.arange(4) / 10, x.shape[2] - 2)[None, None, :, None]
    got = models.WholeDays(inner, 4)(cube)[0, 0, :, 0].tolist()
    given = inner(cube)[0, 0, :, 0].tolist()
    assert len(got) == 20 and got == [*given[4:0:-1], *given, *given[-2:-6:-1]]
    assert models.WholeDays(lambda x: np.repeat(x, 4, 2), 4)(cube).shape[2] == 20  # nothing is lacking
    for steps in (19, 25, 6, 0):  # an odd rest, too many, too few to mirror
        with pytest.raises(ValueError, match="mirrored"):
            models.WholeDays(lambda x: np.zeros((1, 1, steps, 1)), 4)(cube)  # noqa: B023


def test_noise_of_surface_models_is_bounded_and_repeats():
    cube = np.random.default_rng(0).normal(size=(3, 3, 2, 2))
    build = lambda **k: models.SurfaceModel(["temperature_2m", "other"], np.zeros((3, 3)), np.zeros((6, 6)), **k)
    plain, noisy = build()(cube), build(noise=[0.5, None])(cube)
    more = noisy - plain
    assert (more[..., 1] == 0).all() and (more[..., 0] >= 0).all() and 0.3 < more[..., 0].max() < 0.5
    assert (build(noise=[0.5, None])(cube) == noisy).all() and not (build(noise=[0.5, None], seed=1)(cube) == noisy).all()
    assert not np.allclose(build(noise=[0.5, None])(cube + 1) - build()(cube + 1), more)  # another chunk, other noise
    with pytest.raises(ValueError, match="noises"):
        build(noise=[1.0])


def test_observed_shares(spark):
    cube = spark.range(40_000).selectExpr("id % 2 obs", "cast(id div 2 % 100 as int) south_north", "cast(id div 200 % 20 as int) west_east", "cast(id div 4000 as int) t_idx", "1.0d x", "if(id div 200 % 20 < 10, 5.0d, null) topography")
    got = observed(cube, ["x"], Coverage(0.4, 0.5), Coverage(0.0), seed=3)
    assert got.where("topography is null and x_obs is not null").count() == 0 and got.count() == 40_000
    cells = got.where("x_obs is not null").groupBy("obs", "south_north", "west_east").count().collect()
    assert 0.33 < len(cells) / 2000 < 0.47 and all(1 <= r["count"] <= 9 for r in cells)
    assert len({(r["obs"], r["count"]) for r in cells}) == 2  # an observation's cells report at the same steps
    assert observed(cube.repartition(7), ["x"], Coverage(0.4, 0.5), Coverage(0.0), seed=3).exceptAll(got).isEmpty()
    lost = cube.withColumn("t_idx", F.expr("nullif(t_idx, 1)"))
    assert observed(lost, ["x"], Coverage(1.0)).where("t_idx is null and x_obs is not null").isEmpty() and observed(cube.limit(0), ["x"], Coverage(1.0)).isEmpty()
    assert observed(cube, ["x"], Coverage(1.0)).where("x_obs is null").isEmpty()
