"""Queries: solar irradiance, quality checks, losses, streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from .cubes import HISTORY_SQL, SITES_SQL, SMALL_SQL, cube_small, histories, sites, table
from .finish import finish, n, r, t
from .operators import losses, profiles, qa, raster, solar
from .queries import SQL, query
from .queries_grid import INDEXED
from .queries_raster import CELL, KEY

SKY = f"{SMALL_SQL}, sky as (select *, least(v_100m / 80, 1.1) cr, ghi * 12 cg, temperature_2m * 9 cd, clearsky_ghi za, 850 + u_100m pr, dayofyear(time) doy, 0.1 * west_east distance from cube), s1 as (select *, case when distance <= 0.25 then cg * cr else 0 end g from sky)"
DAY = "(2 * pi() * (doy - 1) / 365)"
TOP = f"(1370.0 * (1.00011 + 0.034221 * cos({DAY}) + 0.00128 * sin({DAY}) + 0.000719 * cos(2 * {DAY}) + 0.000077 * sin(2 * {DAY})))"
SOLAR = f"""{SKY}, s2 as (select *, {TOP} tp, case when g is null then 1 when {TOP} is null then null else least(1, greatest(0, g / ({TOP} * greatest(cos(radians(za)), 0.065)))) end kt0,
 least(12.0, 1 / (cos(radians(za)) + 0.15 * greatest(93.885 - za, 1e-6) ** -1.253) * pr / 1013.25) am from s1), s3 as (select *, kt0 kt from s2),
s4 as (select *, case when kt <= 0.6 then 0.512 - 1.56 * kt + 2.286 * kt ** 2 - 2.222 * kt ** 3 else -5.743 + 21.77 * kt - 27.49 * kt ** 2 + 11.56 * kt ** 3 end a,
 case when kt <= 0.6 then 0.37 + 0.962 * kt else 41.4 - 118.5 * kt + 66.05 * kt ** 2 + 31.9 * kt ** 3 end b, case when kt <= 0.6 then -0.28 + 0.932 * kt - 2.048 * kt ** 2 else -47.01 + 184.2 * kt - 222.0 * kt ** 2 + 73.81 * kt ** 3 end c from s3),
s5 as (select *, case when za < 87 and g > 0 then greatest(tp * (0.866 - 0.122 * am + 0.0121 * am * am - 0.000653 * am ** 3 + 0.000014 * am ** 4 - (a + b * exp(c * am))), 0) else 0 end dd from s4),
s6 as (select *, case when distance <= 0.25 and za < 90 then case when cr < 0.99 then least(cd, dd) else cd end else 0 end dn from s5)"""
WHOLE = "u_100m is not null and v_100m is not null and ghi is not null and temperature_2m is not null and clearsky_ghi is not null"


@query(f"""with {SOLAR} select {KEY}, {t("time")}, {r("g", "ghi", 7)}, {r("dn", "dni", 7)}, {r("case when distance <= 0.25 and za < 90 then greatest(0, g - dn * cos(radians(za))) else 0 end", "dhi", 7)} from s6 where {WHOLE}""")
def solar_irradiance(spark, sf_dir):
    c = F.col
    df = cube_small(spark, sf_dir).dropna(subset=["u_100m", "v_100m", "ghi", "temperature_2m", "clearsky_ghi"])
    df = df.select(*CELL, "time", F.least(c("v_100m") / 80, F.lit(1.1)).alias("clearsky_ratio"), (c("temperature_2m") * 9).alias("clearsky_dni"), c("clearsky_ghi").alias("solar_zenith_angle"),
                   (c("ghi") * 12).alias("clearsky_ghi"), (850 + c("u_100m")).alias("surface_pressure"), (0.1 * c("west_east")).alias("distance"))
    solar.require(df)
    return finish(solar.irradiance(df, 0.25), *CELL, "time", "ghi", "dni", "dhi", digits=7)


@query(f"""with {SMALL_SQL}, p as (select south_north i, west_east j, max(ghi) / nullif(max(clearsky_ghi), 0) k from cube group by 1, 2) select {KEY}, {t("time")}, {r("clearsky_ghi * k", "clearsky_ghi")} from cube join p on south_north = i and west_east = j""")
def scaled_to_peak(spark, sf_dir):
    return finish(solar.scale_to_peak(cube_small(spark, sf_dir)), *CELL, "time", "clearsky_ghi")


@query(f"""with {SMALL_SQL}, c as (select gid, latitude, longitude, time, ghi from cube where ghi is not null), g as (select distinct gid, latitude + 0.1 latitude, longitude from cube),
pr as (select g.gid sid, c.gid tid, row_number() over (partition by g.gid order by sqrt((g.latitude - c.latitude) ** 2 + (g.longitude - c.longitude) ** 2), c.gid) k, sqrt((g.latitude - c.latitude) ** 2 + (g.longitude - c.longitude) ** 2) d from g, (select distinct gid, latitude, longitude from c) c
where sqrt((g.latitude - c.latitude) ** 2 + (g.longitude - c.longitude) ** 2) < 1.2), m as (select sid, strftime(time, '%m.%d') dy, avg(ghi) x from pr join c on c.gid = tid where k <= 4 group by 1, 2)
select {n("c2.gid", "gid")}, {t("c2.time")}, {r("x", "clearsky_ghi")} from (select distinct cube.gid, cube.time + interval 366 day as time from cube) c2 left join m on sid = c2.gid and dy = strftime(c2.time, '%m.%d')""")
def clearsky_by_day(spark, sf_dir):
    return _clearsky_by_day(spark, sf_dir)


@query(SQL["clearsky_by_day"])
def clearsky_by_day_all(spark, sf_dir):
    """Of every cell."""
    return _clearsky_by_day(spark, sf_dir)


def _clearsky_by_day(spark, sf_dir):
    df = cube_small(spark, sf_dir)
    sky = df.where("ghi is not null").select("gid", "latitude", "longitude", "time", F.col("ghi").alias("clearsky_ghi"))
    cells = df.select("gid", (F.col("latitude") + 0.1).alias("latitude"), "longitude", (F.col("time") + F.expr("interval 366 days")).alias("time")).distinct()
    return finish(solar.daily_clearsky(cells, sky, 4, 1.2), "gid", "time", "clearsky_ghi")


@query(f"""with {INDEXED}, f as (select south_north // 2 i, west_east // 2 j, t_idx, case when count(ghi) = 4 then sum(ghi) / 4 end x from ix group by 1, 2, 3), c as (select i, j, t_idx // 5 b, coalesce(sum(x), 0) / 5 s from f group by 1, 2, 3),
o as (select south_north // 2 i, west_east // 2 j, t_idx // 5 b, avg(ghi) o from ix group by 1, 2, 3)
select {n("o.i", "south_north")}, {n("o.j", "west_east")}, {n("o.b", "t_block")}, {r("s", "synthetic")}, {r("o", "true_value")}, {r("s - o", "error")} from o join c on o.i = c.i and o.j = c.j and o.b = c.b""")
def recoarsened(spark, sf_dir):
    fine = raster.time_index(cube_small(spark, sf_dir)).select(*CELL, "t_idx", "ghi")
    source = fine.groupBy(*[F.floor(F.col(c) / 2).cast("int").alias(c) for c in CELL], F.floor(F.col("t_idx") / 5).cast("int").alias("t_idx")).agg(F.avg("ghi").alias("ghi"))
    done = qa.recoarsen_error(fine, source, ["ghi"], 2, 5)
    return finish(done.withColumnsRenamed({"ghi_synthetic": "synthetic", "ghi_true": "true_value", "ghi_error": "error"}), *CELL, "t_block", "synthetic", "true_value", "error")


def _distribution(step: str) -> str:
    return f"""with {SMALL_SQL}, d as (select {step} x from cube), b as (select least(floor((x + 60) / 6)::int, 19) bin from d where x between -60 and 60) select bin::bigint bin, count(*)::bigint count, {r("count(*) / (sum(count(*)) over () * 6.0)", "density")} from b group by bin"""


@query(_distribution("u_100m - lag(u_100m) over (partition by south_north, time order by west_east)"))
def gradient_distribution(spark, sf_dir):
    return finish(qa.gradient_distribution(cube_small(spark, sf_dir), "u_100m", -60.0, 60.0, 20), "bin", "count", "density")


@query(_distribution("u_100m - lag(u_100m, 2) over (partition by south_north, west_east order by time)"))
def time_derivative_distribution(spark, sf_dir):
    return finish(qa.time_derivative_distribution(cube_small(spark, sf_dir), "u_100m", -60.0, 60.0, 20, 2), "bin", "count", "density")


@query(_distribution("u_100m / 2 - 30"))
def direct_distribution(spark, sf_dir):
    df = cube_small(spark, sf_dir).withColumn("u_100m", F.col("u_100m") - 60)
    return finish(qa.direct_distribution(df, "u_100m", -60.0, 60.0, 20, 2.0), "bin", "count", "density")


BOTH = f"{INDEXED}, lo as (select t_idx // 10 obs, south_north, west_east, t_idx % 10 t_idx, coalesce(u_100m, 50) u, coalesce(v_100m, 50) v, coalesce(u_100m, 50) * 0.9 + 3 u_hat, coalesce(v_100m, 50) + 1 v_hat from ix)"


def _both(spark, sf_dir):
    df = raster.time_index(cube_small(spark, sf_dir))
    true = df.select(F.floor(F.col("t_idx") / 10).alias("obs"), *CELL, F.pmod("t_idx", F.lit(10)).alias("t_idx"), F.coalesce("u_100m", F.lit(50.0)).alias("u"), F.coalesce("v_100m", F.lit(50.0)).alias("v"))
    fake = true.withColumns({"u": F.col("u") * 0.9 + 3, "v": F.col("v") + 1})
    return losses.pair(true, fake, ["u", "v"])


def _extremes(over: str) -> str:
    return f"(select (avg(abs(a - b)) + avg(abs(c - d)) + avg(abs(e - f)) + avg(abs(g - h))) / 4 from (select min(u) a, min(u_hat) b, min(v) c, min(v_hat) d, max(u) e, max(u_hat) f, max(v) g, max(v_hat) h from lo group by {over}))"


def _slope(x: str, axis: str, by: str) -> str:
    w = f"over (partition by obs, {by} order by {axis})"
    return f"(case when lag({axis}) {w} is null then lead({x}) {w} - {x} when lead({axis}) {w} is null then {x} - lag({x}) {w} else (lead({x}) {w} - lag({x}) {w}) / 2 end)"


AXES = {"t_idx": "south_north, west_east", "south_north": "west_east, t_idx", "west_east": "south_north, t_idx"}
SLOPES = ", ".join(f"{_slope(x, a, by)} {x}_{a}" for x in ("u", "v", "u_hat", "v_hat") for a, by in AXES.items())


def _flow(f: str, h: str) -> str:
    return f"({f}{h}_t_idx + u{h} * {f}{h}_south_north + v{h} * {f}{h}_west_east)"


@query(f"""with {BOTH}, sl as (select *, {SLOPES} from lo), means as (select avg(u) a, avg(u_hat) b, avg(v) c, avg(v_hat) d from lo group by obs, t_idx)
select * from (select 'mae' name, {r("(avg(abs(u - u_hat)) + avg(abs(v - v_hat))) / 2", "loss")} from lo union all select 'mse', {r("(avg((u - u_hat) ** 2) + avg((v - v_hat) ** 2)) / 2", "loss")} from lo
union all select 'exp', {r("(avg(1 - exp(-((u - u_hat) ** 2))) + avg(1 - exp(-((v - v_hat) ** 2)))) / 2", "loss")} from lo union all select 'coarse_mse', {r("(avg((a - b) ** 2) + avg((c - d) ** 2)) / 2", "loss")} from means
union all select 'spatial_extremes', {r(_extremes("obs, t_idx"), "loss")} union all select 'temporal_extremes', {r(_extremes("obs, south_north, west_east"), "loss")}
union all select 'spatial_derivative', {r("(avg(abs(u_south_north - u_hat_south_north)) + avg(abs(u_west_east - u_hat_west_east)) + avg(abs(v_south_north - v_hat_south_north)) + avg(abs(v_west_east - v_hat_west_east))) / 4", "loss")} from sl
union all select 'temporal_derivative', {r("(avg(abs(u_t_idx - u_hat_t_idx)) + avg(abs(v_t_idx - v_hat_t_idx))) / 2", "loss")} from sl
union all select 'material_derivative', {r(f"(avg(abs({_flow('u', '')} - {_flow('u', '_hat')})) + avg(abs({_flow('v', '')} - {_flow('v', '_hat')}))) / 2", "loss")} from sl)""")
def training_losses(spark, sf_dir):
    return finish(losses.together(_both(spark, sf_dir), ["u", "v"], [*losses.LOSSES, "material_derivative"]))


def _transform(x: str, angle: str) -> str:
    return f"(sum({x} * cos({angle})) ** 2 + sum({x} * sin({angle})) ** 2)"


TURN = "2 * pi() * k * t_idx / len"


@query(f"""with {INDEXED}, z as (select gid, t_idx, len, coalesce(u_100m, 0) u, coalesce(v_100m, 0) v from ix),
tr as (select gid, k, len, {_transform("u", TURN)} + {_transform("v", TURN)} e from z, (select distinct t_idx k from ix) ks group by gid, k, len), e as (select k, len, sum(e) e from tr group by k, len)
select 0::bigint k, {r("a.k", "frequency")}, {r("a.k ** 2 * a.e + b.k ** 2 * b.e", "energy", 1)} from e a join e b on b.k = a.len - 1 - a.k where a.k < a.len // 2""")
def frequency_spectrum(spark, sf_dir):
    df = raster.time_index(cube_small(spark, sf_dir)).fillna(0.0).withColumn("k", F.lit(0))
    return finish(qa.frequency_spectrum(df, ["u_100m", "v_100m"], ["k"]).withColumn("energy", F.round("energy", 1)))


@query(f"""with {SMALL_SQL}, tr as (select south_north, strftime(time, '%Y-%m-%d') dy, k, {_transform("coalesce(u_100m, 0)", "2 * pi() * k * west_east / 4")} + {_transform("coalesce(v_100m, 0)", "2 * pi() * k * west_east / 4")} e
from cube, unnest(range(0, 4)) ks(k) group by south_north, dy, k), e as (select dy, k, sum(e) e from tr group by dy, k)
select a.dy as day, {r("a.k - 1", "wavenumber")}, {r("a.k ** 2 * a.e + b.k ** 2 * b.e", "energy", 1)} from e a join e b on a.dy = b.dy and b.k = 4 - a.k where a.k between 1 and 2""")
def wavenumber_spectrum(spark, sf_dir):
    df = cube_small(spark, sf_dir).fillna(0.0).withColumn("day", F.date_format("time", "yyyy-MM-dd"))
    return finish(qa.wavenumber_spectrum(df, ["u_100m", "v_100m"], ["day"]).withColumn("energy", F.round("energy", 1)))


PLANE = "2 * pi() * (kx * south_north + ky * west_east) / 4"


@query(f"""with {BOTH}, tr as (select obs, t_idx, kx, ky, {_transform("u", PLANE)} a, {_transform("u_hat", PLANE)} b from lo, unnest(range(0, 4)) k1(kx), unnest(range(0, 4)) k2(ky) group by obs, t_idx, kx, ky)
select {r("avg(abs(ln(1 + sqrt(a)) - ln(1 + sqrt(b))))", "loss", 7)} from tr""")
def fft_loss(spark, sf_dir):
    return finish(losses.fft_loss(_both(spark, sf_dir), "u"), digits=7)


@query(f"""with {BOTH}, p as (select a.obs i, b.obs j, sum((a.u - b.u) ** 2) x, sum((a.u_hat - b.u_hat) ** 2) y, sum((a.u - b.u_hat) ** 2) z from lo a join lo b using (south_north, west_east, t_idx) group by a.obs, b.obs)
select {r("avg(exp(-x / 2e6)) + avg(exp(-y / 2e6)) - 2 * avg(exp(-z / 2e6))", "loss")} from p""")
def mmd(spark, sf_dir):
    return finish(losses.mmd(_both(spark, sf_dir), "u", 1000.0))


@query(f"""with {BOTH} select {r("0.7 * (avg(abs(u - u_hat)) + avg(abs(v - v_hat))) / 2 + 0.3 * (avg((u - u_hat) ** 2) + avg((v - v_hat) ** 2)) / 2", "loss")} from lo""")
def weighted_loss(spark, sf_dir):
    return finish(losses.weighted(_both(spark, sf_dir), ["u", "v"], {"mae": 0.7, "mse": 0.3}))


@query(f"""with {BOTH}, c as (select avg(u) u, avg(u_hat) u_hat from lo group by obs, t_idx, south_north // 2, west_east // 2 having count(*) = 4) select {r("avg(abs(u - u_hat))", "loss")} from c""")
def low_res_loss(spark, sf_dir):
    return finish(losses.low_res(_both(spark, sf_dir), ["u"], 2))


@query(f"""select {n("user_id % 16", "gid")}, {t("date_trunc('day', ts)", "day_start")}, {r("avg(value)", "value")} from events group by 1, 2""")
def streamed_daily(spark, sf_dir):
    """The streaming aggregation run over the table as one batch."""
    from .streaming.daily import stream_daily

    df = table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(16)).alias("gid"), F.col("ts").cast("timestamp").alias("time"), "value")
    return finish(stream_daily(df, ["value"]).withColumnRenamed("day", "day_start"), "gid", "day_start", "value")


@query(f"""with {HISTORY_SQL}, {SITES_SQL}, p as (select gid, latitude + 0.021 latitude, longitude + 0.033 longitude from sites),
pr as (select p.gid sid, s.gid tid, sqrt((p.latitude - s.latitude) ** 2 + (p.longitude - s.longitude) ** 2) d from p cross join (select * from sites where gid in (select gid from base)) s),
k as (select *, row_number() over (partition by sid order by d, tid) rank from pr where d < 0.15)
select {n("sid", "gid")}, dayofyear(time)::bigint doy, hour(time)::bigint as hour, {r("min(d)", "distance")}, {r("avg(x)", "x")} from k join base on base.gid = tid where rank <= 2 group by sid, dayofyear(time), hour(time)""")
def matched_clearsky(spark, sf_dir):
    return _matched_clearsky(spark, sf_dir)


@query(SQL["matched_clearsky"])
def matched_clearsky_all(spark, sf_dir):
    """Of every site."""
    return _matched_clearsky(spark, sf_dir)


def _matched_clearsky(spark, sf_dir):
    s = sites(spark, sf_dir)
    sky = histories(spark, sf_dir)[0].join(s.select("gid", "latitude", "longitude"), "gid")
    wanted = s.select("gid", (F.col("latitude") + 0.021).alias("latitude"), (F.col("longitude") + 0.033).alias("longitude"))
    return finish(solar.match_clearsky(wanted, sky, 2, 0.15), "gid", "doy", "hour", "distance", "x")


@query(f"""with m as (select month(l_shipdate) mo, l_suppkey % 5 la, l_linenumber * 20 height, avg(l_quantity) ws from lineitem group by all),
s as (select mo, la, list(struct_pack(lev := height::double, ws := ws) order by height) s from m where height <> 60 group by mo, la),
w as (select mo, la, s, h, greatest(1, least(len(s) - 1, len(list_filter(s, lambda p: p.lev <= h)))) k from s, unnest([10.0::double, 70.0::double, 200.0::double]) t(h) where len(s) >= 2)
select {n("mo", "mon")}, {r("la", "latitude")}, {r("h", "height")}, {r("s[k].ws + (h - s[k].lev) * (s[k + 1].ws - s[k].ws) / (s[k + 1].lev - s[k].lev)", "ws")} from w""")
def heights_of_monthly_means(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    means = lines.groupBy(F.month("l_shipdate").alias("mon"), F.pmod("l_suppkey", F.lit(5)).cast("double").alias("latitude"), (F.col("l_linenumber") * 20).alias("height")).agg(F.avg("l_quantity").alias("ws"))
    gaps = means.withColumn("ws", F.when(F.col("height") == 60, -999.0).otherwise(F.col("ws")))
    return finish(profiles.monthly_means_to_heights(gaps, [10.0, 70.0, 200.0], ("mon", "latitude")), "mon", "latitude", "height", "ws")
