"""Queries: plans and commands over written data sets, samples and members."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from .cubes import HISTORY_SQL, SITES_SQL, SMALL_SQL, cube_small, histories, sites
from .finish import finish, n, r, t
from .operators import bias, coarsen, sampling, standardize, stats
from .operators.raster import time_index
from .plans import cli, pairs
from .plans.handler import handler_by_name
from .queries import query
from .queries_grid import INDEXED, _gauss
from .queries_more import _place
from .queries_raster import CELL, KEY
from .sources import scan, sinks


@query(f"""with {HISTORY_SQL}, {SITES_SQL},
m as (select b.gid, bm / sm scalar from (select gid, avg(x) bm from base group by gid) b join (select gid, avg(x) sm from bias group by gid) s on s.gid = b.gid),
pr as (select c.gid cell, s.gid, (c.latitude - 0.06 - s.latitude) ** 2 + (c.longitude + 0.02 - s.longitude) ** 2 d from sites c, sites s join m on m.gid = s.gid),
best as (select cell, arg_min(gid, struct_pack(d := d, g := gid)) gid from pr where d < 0.04 group by cell)
select {n("cell", "gid")}, {r("scalar", "scalar")} from best join m on m.gid = best.gid""")
def factors_of_cells(spark, sf_dir):
    """Stored factors of the nearest place under each cell's gid."""
    base, modelled, _ = histories(spark, sf_dir)
    path = f"{_place(spark)}/factors"
    factors = bias.linear_factors(base, modelled, "x", True).join(sites(spark, sf_dir).select("gid", "latitude", "longitude"), "gid")
    sinks.write_factors(factors.where("scalar is not null"), path, {"method": "scalar"})
    known = sites(spark, sf_dir).select("gid", (F.col("latitude") - 0.06).alias("latitude"), (F.col("longitude") + 0.02).alias("longitude"))
    near = known.join(scan.nn_join(known, spark.read.parquet(path).select("gid", "latitude", "longitude"), 0.2).where("tid is not null").select(F.col("sid").alias("gid")), "gid", "left_semi")
    return finish(scan.bias_factors(spark, path, ["scalar", "adder"], cells=near, threshold=0.2), "gid", "scalar")


@query(f"""with {INDEXED}, f as (select south_north // 2 i, west_east // 2 j, t_idx, case when count(ghi) = 4 then sum(ghi) / 4 end x from ix group by 1, 2, 3), c as (select i, j, t_idx // 5 b, coalesce(sum(x), 0) / 5 s from f group by 1, 2, 3),
o as (select south_north // 2 i, west_east // 2 j, t_idx // 5 b, avg(ghi) * (1 + 0.1 * (south_north // 2 * 2 + west_east // 2)) + 3 o from ix group by 1, 2, 3)
select {n("o.i", "south_north")}, {n("o.j", "west_east")}, {n("o.b", "t_block")}, {r("s::float", "synthetic", 3)}, {r("o::float", "true_value", 3)} from o join c on o.i = c.i and o.j = c.j and o.b = c.b""")
def qa_command(spark, sf_dir):
    """The qa command over written data, its source corrected first."""
    place = _place(spark)
    fine = time_index(cube_small(spark, sf_dir)).select(*CELL, "t_idx", "time", "ghi")
    block = {c: F.floor(F.col(c) / k).cast("int") for c, k in (("south_north", 2), ("west_east", 2), ("t_idx", 5))}
    source = fine.groupBy(*[b.alias(c) for c, b in block.items()]).agg(F.avg("ghi").alias("ghi"), F.min("time").alias("time")).withColumn("gid", F.col("south_north") * 2 + F.col("west_east"))
    factors = source.select("gid").distinct().select("gid", F.lit(0).alias("t_idx"), (1 + 0.1 * F.col("gid")).alias("scalar"), F.lit(3.0).alias("adder"))
    for name, df in (("fine", fine), ("source", source), ("factors", factors)):
        df.write.parquet(f"{place}/{name}")
    cli.run(spark, [{"command": "qa", "fine": f"{place}/fine", "source": f"{place}/source", "features": ["ghi"], "s": 2, "t": 5, "out": f"{place}/out", "bias_method": "linear", "factors": f"{place}/factors"}])
    done = spark.read.parquet(f"{place}/out").withColumnsRenamed({"ghi_synthetic": "synthetic", "ghi_true": "true_value"})
    return finish(done, *CELL, "t_block", "synthetic", "true_value", digits=3)


def _drawn() -> tuple[int, int, int]:
    rng = random.Random(42)
    return (*sampling.weighted_box(4, 4, (2, 3), [1.0, 3.0], rng), sampling.weighted_start(20, 6, [0.2, 0.8], rng))


_ROW, _COLUMN, _STEP = _drawn()


@query(f"""with {INDEXED} select {n(f"south_north - {_ROW}", "i")}, {n(f"west_east - {_COLUMN}", "j")}, {n(f"t_idx - {_STEP}", "t")}, {r("ghi", "ghi")} from ix
where south_north between {_ROW} and {_ROW + 1} and west_east between {_COLUMN} and {_COLUMN + 2} and t_idx between {_STEP} and {_STEP + 5}""")
def weighted_sample(spark, sf_dir):
    """A box and a run of steps drawn by weights."""
    df = time_index(cube_small(spark, sf_dir)).select(*CELL, "t_idx", "ghi")
    return finish(sampling.cut_samples(df, *_drawn(), (2, 3, 6)), "i", "j", "t", "ghi")


_KEPT = {"u_100m": (100, -120, 120), "ghi": (1, 0, 1350), "temperature_2m": (100, -200, 100)}


@query(f"""with {SMALL_SQL} select {KEY}, {t("time")}, {", ".join(r(f"case when {f} is not null then round_even(least(greatest({f}, {lo}), {hi}) * {k}, 0) / {k} end", f) for f, (k, lo, hi) in _KEPT.items())} from cube""")
def stored_integers(spark, sf_dir):
    """Features written as integers and scaled back on reading."""
    path = f"{_place(spark)}/out"
    sinks.write_output(cube_small(spark, sf_dir).select(*CELL, "time", *_KEPT), path, list(_KEPT), integers=True)
    back = spark.read.parquet(path)
    return finish(standardize.unscale(back, {f: back.schema[f].metadata["scale_factor"] for f in _KEPT}), *CELL, "time", *_KEPT)


@query(f"""with {INDEXED}, fine as (select * from ix where south_north < 3 and west_east < 3), coarse as (select t_idx // 5 b, avg(ghi) low from fine group by 1)
select {KEY}, {n("t_idx")}, {r("ghi", "ghi")}, {r("low", "ghi_low")} from fine join coarse on b = t_idx // 5""")
def paired_members(spark, sf_dir):
    """Fine rows trimmed to whole blocks beside the coarse member's value of their block."""
    fine = time_index(cube_small(spark, sf_dir))
    steps = fine.where("south_north < 3 and west_east < 3").groupBy(F.floor(F.col("t_idx") / 5).cast("int").alias("t_idx")).agg(F.avg("ghi").alias("ghi"), F.min("time").alias("time"))
    low = steps.withColumns({c: F.lit(0) for c in CELL})
    both = pairs.pair(low, fine, ["ghi"], 4, 4, 3, 5, regrid=False, most_missing=101.0)
    return finish(sampling.align(both.low, both.high.select(*CELL, "t_idx", "ghi"), ["ghi"], 3, 5), *CELL, "t_idx", "ghi", "ghi_low")


@query(f"""with {HISTORY_SQL} select {n("gid")}, {t("date_trunc('day', time)", "date")}, {r("round_even(avg(x), 1)", "x")} from base group by gid, date_trunc('day', time)""")
def rounded_daily(spark, sf_dir):
    """Daily means rounded half to even."""
    return finish(coarsen.reduce_daily(histories(spark, sf_dir)[0].withColumn("x", F.col("x").cast("double")), "x", "avg", decimals=1))


@query(f"""with {SMALL_SQL} select {KEY}, {t("time")}, {r("u_100m", "u_100m")}, {r("v_100m", "v_100m")} from cube""")
def cached_features(spark, sf_dir):
    """One data set a feature: what is missing is written, what is there is read."""
    pattern, cube = f"{_place(spark)}/{{feature}}", cube_small(spark, sf_dir)
    keys = [*CELL, "time"]
    sinks.write_features(cube, pattern, ["u_100m"], keys)
    have, lacking = scan.cached(spark, pattern, ["u_100m", "v_100m"])
    sinks.write_features(cube, pattern, [*have, *lacking], keys)
    return finish(scan.read_cached(spark, pattern, ["u_100m", "v_100m"], keys), *keys, "u_100m", "v_100m")


@query(f"""with {SMALL_SQL}, {_gauss(0.7)},
m as (select gid, any_value(south_north) i, any_value(west_east) j, avg(u_100m) bm, stddev_pop(u_100m) bs, avg(v_100m) mm, stddev_pop(v_100m) ms from cube group by gid),
f as (select gid, i, j, bs / ms scalar, bm - mm * bs / ms adder from m),
a as (select p.i, f.j, sum(f.scalar * w) scalar, sum(f.adder * w) adder from (select distinct i from f) p cross join gw join f on f.i = least(greatest(p.i + k, 0), 3) group by p.i, f.j),
b as (select a.i, q.j, sum(a.scalar * w) scalar, sum(a.adder * w) adder from (select distinct j from f) q cross join gw join a on a.j = least(greatest(q.j + k, 0), 3) group by a.i, q.j)
select {KEY}, {t("time")}, {r("v_100m * least(greatest(scalar, 0.9), 1.1) + case when adder is not null then least(greatest(adder, -3), 3) end", "v_100m", 6)} from cube join b on b.i = south_north and b.j = west_east""")
def corrected_smoothed(spark, sf_dir):
    """Linear correction with factors smoothed over the grid and held to ranges."""
    cube = cube_small(spark, sf_dir)
    series = lambda f: cube.select("gid", "time", F.col(f).alias("v_100m"))
    factors = bias.linear_factors(series("u_100m"), series("v_100m"), "v_100m").join(cube.select("gid", *CELL).distinct(), "gid")
    done = bias.apply_linear(cube, factors, "v_100m", scalar_range=(0.9, 1.1), adder_range=(-3, 3), smoothing=0.7)
    return finish(done, *CELL, "time", "v_100m", digits=6)


@query(f"""with {SMALL_SQL}, x as (select south_north i, west_east j, dense_rank() over (order by time) - 1 k, time, ghi from cube),
steps as (select max(k) + 1 n from x),
moved as (select i, j, (k + 2) % n k, ghi from x, steps)
select {n("x.i", "south_north")}, {n("x.j", "west_east")}, {t("x.time + interval 30 minute", "time")}, {r("coalesce(m.ghi, 0)", "ghi")} from x join moved m on m.i = x.i and m.j = x.j and m.k = x.k""")
def rolled_handler(spark, sf_dir):
    """A handler that rolls values in time and shifts the times."""
    cube = cube_small(spark, sf_dir).withColumn("ghi", F.coalesce("ghi", F.lit(0.0)))
    return finish(handler_by_name("base", features=["ghi"], time_roll=2, time_shift=30).run(cube), *CELL, "time", "ghi")


@query(f"""with {SMALL_SQL}, b as (select south_north g, least(floor(ghi / 0.5)::int, 199) bin, count(*)::double c from cube where ghi between 0 and 100 group by 1, 2),
x as (select g, bin from (select distinct g from b), unnest(range(0, 200)) t(bin)),
a as (select x.g, x.bin, b.c, p.bin pb, p.c pc, q.bin qb, q.c qc from x left join b on b.g = x.g and b.bin = x.bin asof left join b p on p.g = x.g and p.bin <= x.bin asof left join b q on q.g = x.g and q.bin >= x.bin),
f as (select g, bin, coalesce(c, pc + (qc - pc) * (bin - pb) / (qb - pb), 0) c from a)
select {n("g", "south_north")}, {n("bin")}, {r("c", "count")}, {r("c / sum(c) over (partition by g)", "share")} from f""")
def filled_density(spark, sf_dir):
    """Shares of narrow bins by row of cells, gaps between them filled along lines."""
    return finish(stats.filled_histogram(cube_small(spark, sf_dir), "ghi", 0.0, 100.0, 200, ("south_north",)), "south_north", "bin", "count", "share")


def _queue(df=None):
    return sampling.BatchQueue([(df, 4, 4, 20)], ["ghi"], (2, 4, 6), 2, 3, batch_size=3, n_batches=2, seed=7, smoothing=0.6)


def _draws() -> str:
    queue = _queue()
    rows = [(b, o, *queue.draw()[1:]) for b in range(2) for o in range(3)]
    return "draws as (select * from (values " + ", ".join(map(str, rows)) + ") d(batch, obs, r0, c0, t0))"


@query(f"""with {INDEXED}, {_draws()}, {_gauss(0.6)},
fine as (select batch, obs, south_north - r0 i, west_east - c0 j, t_idx - t0 k, coalesce(ghi, 0) x from draws join ix on south_north between r0 and r0 + 1 and west_east between c0 and c0 + 3 and t_idx between t0 and t0 + 5),
block as (select batch, obs, i // 2 bi, j // 2 bj, k, case when count(x) = 4 then sum(x) / 4 end x from fine group by all),
low as (select batch, obs, bi i, bj j, k // 3 k, coalesce(sum(x), 0) / 3 x from block group by batch, obs, bi, bj, k // 3),
a as (select low.batch, low.obs, low.i, p.j, low.k, sum(low.x * w) x from (select distinct j from low) p cross join gw join low on low.j = least(greatest(p.j + gw.k, 0), 1) group by all)
select {n("batch")}, {n("obs")}, {n("i", "south_north")}, {n("j", "west_east")}, {n("k", "t_idx")}, {r("x", "ghi", 6)} from a""")
def epoch_of_batches(spark, sf_dir):
    """All batches of an epoch in one plan, coarse members smoothed."""
    df = time_index(cube_small(spark, sf_dir)).select(*CELL, "t_idx", F.coalesce("ghi", F.lit(0.0)).alias("ghi"))
    return finish(_queue(df).epoch()[0], "batch", "obs", *CELL, "t_idx", "ghi", digits=6)
