"""Queries: standardising, cropping, masking, derived quantities, coarsening, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .cubes import SMALL_SQL, WIDE_SQL, cube_small, cube_wide, table
from .finish import finish, n, r, t
from .functions import scalars as S
from .functions import times as T
from .functions.names import basename_column, height_column, snake_column
from .operators import coarsen, raster, standardize, stats, windows
from .plans.features import derive
from .plans.handler import Handler
from .queries import query

KEY = f"{n('south_north')}, {n('west_east')}"
CELL = ("south_north", "west_east")
PMOD = "((({0}) % {1}) + {1}) % {1}"


@query(f"""with {SMALL_SQL}, w as (select *, sqrt(u_100m * u_100m + v_100m * v_100m) ws from cube),
c as (select south_north // 2 south_north, west_east // 2 west_east, time, avg(ws) ws from w group by all),
i as (select *, dense_rank() over (order by time) - 1 t_idx from c)
select {KEY}, {n("t_idx // 5", "t_block")}, {r("coalesce(sum(ws), 0) / 5", "windspeed_100m")} from i group by south_north, west_east, t_idx // 5""")
def flagship(spark, sf_dir):
    """Crop, derive wind speed, coarsen in space, then in time."""
    made = Handler(features=["windspeed_100m"], target=(38.5, -105.0), shape=(4, 4), coarsen_by=2).run(cube_small(spark, sf_dir))
    return finish(coarsen.temporal(made, ["windspeed_100m"], 5), *CELL, "t_block", "windspeed_100m")


@query(f"""with {SMALL_SQL} select {KEY}, {t("time")}, {r("temperature_2m - 273.15", "temperature_2m")}, {r(PMOD.format("longitude * 3 + 180", 360) + " - 180", "longitude")} from cube""")
def standard_values(spark, sf_dir):
    df = cube_small(spark, sf_dir).withColumn("longitude", F.col("longitude") * 3)
    return finish(standardize.standardize(df.withColumnRenamed("temperature_2m", "T2M"), {"T2M": "temperature_2m"}, {"t2m": "K", "temperature_2m": "K"}), *CELL, "time", "temperature_2m", "longitude")


@query(f"""with {SMALL_SQL}, g as (select distinct latitude, longitude from cube)
select {n("dense_rank() over (order by latitude desc) - 1", "south_north")}, {n("dense_rank() over (order by longitude) - 1", "west_east")}, {r("latitude", "latitude")}, {r("longitude", "longitude")} from g""")
def grid_index(spark, sf_dir):
    return finish(standardize.grid_index(cube_small(spark, sf_dir).select("latitude", "longitude")))


@query(f"""with {SMALL_SQL} select {KEY}, {t("time")}, {r("u_100m / 100.0", "unscaled")}, {r("round_even(u_100m * 100.0, 0)", "scaled")} from cube""")
def scale_factors(spark, sf_dir):
    df = cube_small(spark, sf_dir).withColumns({"unscaled": F.col("u_100m"), "scaled": F.col("u_100m")})
    return finish(standardize.scale(standardize.unscale(df, {"unscaled": 100.0}), {"scaled": 100.0}).withColumn("scaled", F.col("scaled").cast("double")), *CELL, "time", "unscaled", "scaled")


@query(f"""with {SMALL_SQL}, g as (select distinct south_north i, west_east j, latitude, longitude from cube),
b as (select i, j from g order by sqrt((latitude - 38.9) ** 2 + (longitude + 104.6) ** 2), i, j limit 1)
select {n("south_north - greatest(i - 1, 0)", "south_north")}, {n("west_east - j", "west_east")}, {t("time")}, {r("u_100m", "u_100m")}
from cube, b where south_north between greatest(i - 1, 0) and i and west_east between j and j + 1""")
def crop(spark, sf_dir):
    df = cube_small(spark, sf_dir)
    return finish(raster.crop(df, df.select(*CELL, "latitude", "longitude").distinct(), (38.9, -104.6), (2, 2), 1.0), *CELL, "time", "u_100m")


@query(f"""with {SMALL_SQL}, i as (select *, dense_rank() over (order by time) - 1 k from cube)
select {KEY}, {t("time")}, {r("v_100m", "v_100m")} from i where k >= 3 and k < 21 and (k - 3) % 4 = 0""")
def time_slice(spark, sf_dir):
    return finish(raster.time_slice(cube_small(spark, sf_dir), 3, 21, 4), *CELL, "time", "v_100m")


@query(f"""with {SMALL_SQL}, bad as (select time from cube group by time having bool_or(u_100m is null or ghi is null))
select {KEY}, {t("time")}, {r("u_100m", "u_100m")}, {r("ghi", "ghi")} from cube where time not in (select time from bad)""")
def null_steps(spark, sf_dir):
    return finish(raster.drop_null_steps(cube_small(spark, sf_dir), ["u_100m", "ghi"]), *CELL, "time", "u_100m", "ghi")


NIGHT = f"{SMALL_SQL}, d as (select time dt, coalesce(bool_or(clearsky_ghi <= 10), false) night from cube group by time), x as (select * from cube join d on time = dt)"


@query(f"""with {NIGHT} select {KEY}, {t("time")}, {r("case when not night then ghi / nullif(clearsky_ghi, 0) end", "clearsky_ratio")},
{r("case when not night then (ghi < clearsky_ghi)::int end", "cloud_mask")}, {r("case when ghi is not null and clearsky_ghi <> 0 then least(greatest(ghi / clearsky_ghi, 0), 1) end", "daily_ratio")} from x""")
def clearsky(spark, sf_dir):
    df = raster.night(cube_small(spark, sf_dir), least=10.0)
    df = derive(df, ["clearsky_ratio", "cloud_mask"])
    return finish(df.withColumn("daily_ratio", S.clearsky_ratio_daily(F.col("ghi"), F.col("clearsky_ghi"))), *CELL, "time", "clearsky_ratio", "cloud_mask", "daily_ratio")


@query("""select year(l_shipdate)::bigint as year, count(*)::bigint rows, min(month(l_shipdate))::bigint first_month, max(dayofyear(l_shipdate))::bigint last_day
from lineitem where not (month(l_shipdate) = 2 and day(l_shipdate) = 29) group by 1""")
def no_leap_days(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").where(~T.leap_day(F.col("l_shipdate")))
    return finish(df.groupBy(F.year("l_shipdate").alias("year")).agg(F.count("*").alias("rows"), F.min(F.month("l_shipdate")).alias("first_month"), F.max(F.dayofyear("l_shipdate")).alias("last_day")))


ROTATION = f"""{SMALL_SQL}, g0 as (select distinct south_north gi, west_east gj, latitude la, longitude + 0.1 * south_north lo from cube),
g1 as (select *, la - lag(la) over w dy, lo - lag(lo) over w dx from g0 window w as (partition by gj order by gi)),
g2 as (select *, pi() / 2 - atan2({PMOD.format("dy + 90", 180)} - 90, {PMOD.format("dx + 180", 360)} - 180) th from g1),
g as (select gi, gj, coalesce(th, lead(th) over (partition by gj order by gi), 0) theta from g2)"""
UROT, VROT = "(cos(theta) * u_100m - sin(theta) * v_100m)", "(sin(theta) * u_100m + cos(theta) * v_100m)"


def _rotated(spark, sf_dir):
    df = cube_small(spark, sf_dir).withColumn("longitude", F.col("longitude") + 0.1 * F.col("south_north"))
    grid = windows.rotation(df.select(*CELL, "latitude", "longitude").distinct())
    return df.join(F.broadcast(grid.select(*CELL, "theta")), list(CELL))


@query(f"with {ROTATION} select {n('gi', 'south_north')}, {n('gj', 'west_east')}, {r('theta', 'theta')} from g")
def rotation(spark, sf_dir):
    return finish(_rotated(spark, sf_dir).select(*CELL, "theta").distinct())


@query(f"""with {ROTATION} select {KEY}, {t("time")}, {r(f"sqrt({UROT} ** 2 + {VROT} ** 2)", "windspeed_100m")},
{r(PMOD.format(f"degrees(atan2({UROT}, {VROT})) + 360", 360), "winddirection_100m")} from cube join g on south_north = gi and west_east = gj""")
def wind_from_uv(spark, sf_dir):
    return finish(derive(_rotated(spark, sf_dir), ["windspeed_100m", "winddirection_100m"]), *CELL, "time", "windspeed_100m", "winddirection_100m")


@query(f"""with {ROTATION}, s as (select *, u_100m ws, v_100m * 3 wd from cube join g on south_north = gi and west_east = gj)
select {KEY}, {t("time")}, {r("cos(theta) * ws * sin(radians(wd)) + sin(theta) * ws * cos(radians(wd))", "u_10m")}, {r("cos(theta) * ws * cos(radians(wd)) - sin(theta) * ws * sin(radians(wd))", "v_10m")},
{r("-ws * sin(radians(wd))", "u_from")}, {r("-ws * cos(radians(wd))", "v_from")} from s""")
def uv_from_wind(spark, sf_dir):
    df = _rotated(spark, sf_dir).withColumns({"windspeed_10m": F.col("u_100m"), "winddirection_10m": F.col("v_100m") * 3})
    u, v = S.from_direction(F.col("windspeed_10m"), F.col("winddirection_10m"))
    return finish(derive(df, ["u_10m", "v_10m"]).withColumns({"u_from": u, "v_from": v}), *CELL, "time", "u_10m", "v_10m", "u_from", "v_from")


ES = "6.1078 * exp(17.1 * {0} / (235 + {0}))"


@query(f"""with {SMALL_SQL} select {KEY}, {t("time")}, {r("100 * " + ES.format("(temperature_2m / 10 - 5)") + " / (" + ES.format("(temperature_2m / 10)") + ")", "relativehumidity_2m")},
{r("u_100m * (80 / 10.0) ** 0.2", "u_80m")}, {r("0.5 * ln(u_100m + 2) + 1", "log_law")}, {r("101325.0 * (1 - (v_100m * 10) / 44307.69231) ** 5.25328", "pressure", 6)},
{r("case when ghi is not null then least(greatest(ghi * 20, 0), 1350) end", "ghi")}, {r("case when ghi * 20 between 0 and 1350 then ghi * 20 end", "ghi_or_null")} from cube""")
def scalar_derivations(spark, sf_dir):
    df = cube_small(spark, sf_dir)
    c = F.col
    return finish(df.select(*CELL, "time", S.surface_rh(c("temperature_2m") / 10, c("temperature_2m") / 10 - 5).alias("relativehumidity_2m"), S.power_law(c("u_100m"), 80).alias("u_80m"),
        S.log_law(c("u_100m"), 0.5, 2, 1).alias("log_law"), F.round(S.pressure_at(c("v_100m") * 10), 6).alias("pressure"), S.enforce("ghi", c("ghi") * 20).alias("ghi"), S.enforce("ghi", c("ghi") * 20, True).alias("ghi_or_null")))


@query(f"""select event_id::bigint event_id, {r("cos(4 * pi() * (hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts))) / 86400.0)", "sod_encoding")},
{r("cos(4 * pi() * ((dayofyear(ts) - 1) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts))) / 31536000.0)", "soy_encoding")} from events""")
def time_encodings(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumnRenamed("ts", "time")
    return finish(derive(df, ["sod_encoding", "soy_encoding"]), "event_id", "sod_encoding", "soy_encoding")


SUN = """sun0 as (select event_id, 40 - 0.5 * (user_id % 16 // 4) la, -105 + 0.5 * (user_id % 4) lo, hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) s, date_diff('day', date '2000-01-01', ts::date) dd from events),
sun1 as (select *, dd - 0.5 + s / 86400.0 nn, s / 3600.0 hh from sun0),
sun2 as (select *, radians((280.460 + 0.9856474 * nn) % 360) ml, radians((357.528 + 0.9856003 * nn) % 360) an, radians(23.439 - 0.0000004 * nn) ti from sun1),
sun3 as (select *, ml + radians(1.915 * sin(an) + 0.020 * sin(2 * an)) ec from sun2),
sun4 as (select *, atan2(cos(ti) * sin(ec), cos(ec)) ra, asin(sin(ti) * sin(ec)) de, (6.697375 + 0.0657098242 * nn + hh) % 24 gm from sun3),
sun5 as (select *, radians(((gm + lo / 15.0) % 24 + 24) % 24 * 15.0) - ra ha from sun4),
sun6 as (select *, degrees(asin(least(1, greatest(-1, sin(de) * sin(radians(la)) + cos(de) * cos(radians(la)) * cos(ha))))) el from sun5)"""


@query(f"""with {SUN} select event_id::bigint event_id, {r("90 - least(90, el + case when el >= -0.56 then 3.51561 * (0.1594 + 0.0196 * el + 0.00002 * el * el) / (1 + 0.505 * el + 0.0845 * el * el) else 0.56 end)", "sza")} from sun6""")
def solar_zenith(spark, sf_dir):
    u = F.col("user_id")
    df = table(spark, sf_dir, "events").withColumns({"time": F.col("ts"), "latitude": 40 - 0.5 * F.floor(F.pmod(u, F.lit(16)) / 4), "longitude": -105 + 0.5 * F.pmod(u, F.lit(4))})
    return finish(derive(df, ["sza"]), "event_id", "sza")


@query("""with p as (select p_partkey, p_size, 'WindSpeedFor' || (p_size % 7) || 'Sites' camel, case p_partkey % 3 when 0 then 'U_' || p_size || 'm' when 1 then 'temp_max_' || p_size || 'Pa' else 'ghi' end name from part)
select p_partkey::bigint p_partkey, regexp_replace(lower(name), '_[0-9]+(\\.[0-9]+)?(m|pa)$', '') base, round(nullif(regexp_extract(lower(name), '_([0-9]+)m$', 1), '')::double, 6) height, 'wind_speed_for' || (p_size % 7) || '_sites' snake from p""")
def feature_names(spark, sf_dir):
    size = F.col("p_size").cast("string")
    kind = F.pmod("p_partkey", F.lit(3))
    name = F.when(kind == 0, F.concat(F.lit("U_"), size, F.lit("m"))).when(kind == 1, F.concat(F.lit("temp_max_"), size, F.lit("Pa"))).otherwise("ghi")
    camel = F.concat(F.lit("WindSpeedFor"), F.pmod("p_size", F.lit(7)).cast("string"), F.lit("Sites"))
    return finish(table(spark, sf_dir, "part").select("p_partkey", basename_column(name).alias("base"), height_column(name).alias("height"), snake_column(camel).alias("snake")))


STEPS = "d as (select epoch(x)::bigint - lag(epoch(x)::bigint) over (order by x) delta from (select distinct date_trunc('day', l_shipdate) x from lineitem)), g as (select delta, count(*) n from d where delta is not null group by 1)"


@query(f"with {STEPS} select (select delta from g order by n desc, delta limit 1)::bigint step, (select min(delta) from g)::bigint nominal")
def time_step(spark, sf_dir):
    return finish(T.time_step(table(spark, sf_dir, "lineitem").select(F.date_trunc("day", "l_shipdate").alias("time"))))


@query(f"""with e as (select time_bucket(interval 6 hour, ts) as time, count(*) n from events group by 1),
x as (select unnest(generate_series(date_trunc('day', min(time)), date_trunc('day', max(time)), interval 6 hour)) as time from e)
select {n("row_number() over (order by x.time) - 1", "t_idx")}, {t("x.time")}, {n("coalesce(n, 0)", "events")} from x left join e on e.time = x.time where not (month(x.time) = 2 and day(x.time) = 29)""")
def time_range(spark, sf_dir):
    """Steps of six hours from the first day of the events to the last, with their number, leap days left out."""
    events = table(spark, sf_dir, "events")
    span = events.agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("a"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("b")).first()
    counts = events.groupBy(F.window("ts", "6 hours")["start"].alias("time")).agg(F.count("*").alias("events"))
    steps = T.time_range(spark, span["a"], span["b"], "6 hours", drop_leap=True)
    return finish(steps.join(counts, "time", "left").withColumn("events", F.coalesce("events", F.lit(0))), "t_idx", "time", "events")


@query(f"""with x as (select distinct date_trunc('day', ts) as time from events), k as (select unnest([0, 1, 2, 3]) part)
select {t("time")}, part::bigint part, {t("time + part * interval 6 hour", "fine_time")} from x, k where not (month(time) = 2 and day(time) = 29)""")
def refined_times(spark, sf_dir):
    return finish(T.refine(table(spark, sf_dir, "events").select(F.date_trunc("day", "ts").alias("time")), 4))


@query(f"""with {SMALL_SQL} select {n("south_north // 2", "south_north")}, {n("west_east // 2", "west_east")}, {t("time")},
{r("case when count(u_100m) = 4 then sum(u_100m) / 4 end", "u_100m")}, {r("case when count(ghi) = 4 then sum(ghi) / 4 end", "ghi")} from cube group by south_north // 2, west_east // 2, time""")
def spatial_coarsening(spark, sf_dir):
    coarsen.check_divisible(4, 4, 2)
    return finish(coarsen.spatial(cube_small(spark, sf_dir), ["u_100m", "ghi"], 2), *CELL, "time", "u_100m", "ghi")


@query(f"""with {WIDE_SQL}, s as (select max(south_north) + 1 nr from wide) select {n("south_north // 4", "south_north")}, {n("west_east // 4", "west_east")}, {t("time")}, {r("avg(u_100m)", "u_100m")}
from wide, s where south_north < 4 * (nr // 4) and west_east < 12 group by south_north // 4, west_east // 4, time""")
def trimmed_coarsening(spark, sf_dir):
    df = cube_wide(spark, sf_dir)
    rows = df.agg(F.max("south_north")).first()[0] + 1
    return finish(coarsen.spatial(coarsen.trim(df, rows, 15, 4), ["u_100m"], 4, strict=False), *CELL, "time", "u_100m")


@query(f"""with {SMALL_SQL}, i as (select *, dense_rank() over (order by time) - 1 k from cube)
select {KEY}, {n("k // 5", "t_block")}, {r("arg_min_null(v_100m, k)", "subsample")}, {r("coalesce(sum(v_100m), 0) / 5", "average")}, {r("coalesce(sum(v_100m), 0)", "total")},
{r("case when count(v_100m) = count(*) then max(v_100m) end", "max")}, {r("case when count(v_100m) = count(*) then min(v_100m) end", "min")} from i group by south_north, west_east, k // 5""")
def temporal_coarsening(spark, sf_dir):
    df = raster.time_index(cube_small(spark, sf_dir))
    out = None
    for m in coarsen.TEMPORAL:
        part = coarsen.temporal(df, ["v_100m"], 5, m).withColumnRenamed("v_100m", m)
        out = part if out is None else out.join(part, [*CELL, "t_block"])
    return finish(out, *CELL, "t_block", "subsample", "average", "total", "max", "min")


@query(f"""select {n("user_id % 16", "gid")}, {t("date_trunc('day', ts)", "date")}, {r("avg(value)", "x")}, {r("max(value)", "x_max_2m")}, {r("min(value)", "x_min_2m")}, {r("sum(value)", "total_x")},
{r("coalesce(sum(value) filter (event_type = 'purchase') / nullif(sum(value) filter (event_type = 'signup'), 0), 0)", "clearsky_ratio")} from events group by user_id % 16, date_trunc('day', ts)""")
def daily(spark, sf_dir):
    v, e = F.col("value"), F.col("event_type")
    df = table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(16)).alias("gid"), F.col("ts").alias("time"), *[v.alias(c) for c in ("x", "x_max_2m", "x_min_2m", "total_x")],
        F.when(e == "purchase", v).alias("ghi"), F.when(e == "signup", v).alias("clearsky_ghi"))
    return finish(coarsen.daily(df, ["x", "x_max_2m", "x_min_2m", "total_x", "clearsky_ratio"], by=("gid",)))


MOMENTS = " union all ".join(f"select '{f}' feature, {r(f'avg({f})', 'mean')}, {r(f'stddev_pop({f})', 'std')} from cube" for f in ("u_100m", "ghi"))


@query(f"with {SMALL_SQL} {MOMENTS}")
def mean_std(spark, sf_dir):
    return finish(stats.mean_std(cube_small(spark, sf_dir), ["u_100m", "ghi"]))


QA = " union all ".join(
    f"select '{f}' feature, {r(f'100.0 * (count(*) - count({f})) / count(*)', 'nan_perc')}, {r(f'stddev_pop({f})', 'std')}, {r(f'avg({f})', 'mean')}, {r(f'min({f})', 'min')}, {r(f'max({f})', 'max')} from wide" for f in ("u_100m", "v_100m", "temperature_2m")
)


@query(f"with {WIDE_SQL} {QA}")
def qa_table(spark, sf_dir):
    return finish(stats.qa_table(cube_wide(spark, sf_dir), ["u_100m", "v_100m", "temperature_2m"]))


@query(f"""with {SMALL_SQL}, c as (select south_north // 2 k, count(*) n, avg(u_100m) m, stddev_pop(u_100m) s from cube group by 1)
select 'u_100m' feature, {r("sum(n * m) / sum(n)", "mean")}, {r("sqrt(sum(n * s * s) / sum(n))", "std")} from c""")
def pooled_stats(spark, sf_dir):
    df = cube_small(spark, sf_dir).withColumn("container_id", F.floor(F.col("south_north") / 2))
    return finish(stats.pooled(df, ["u_100m"]))


@query(f"""with {SMALL_SQL} select {KEY}, {t("time")}, {r("(u_100m - 50) / 25", "u_100m")}, {r("v_100m - 10", "v_100m")}, {r("ghi * 2", "ghi")}, {r("temperature_2m ** 2", "temperature_2m")} from cube""")
def normalized(spark, sf_dir):
    df = stats.normalize(cube_small(spark, sf_dir), {"u_100m": 50.0, "v_100m": 10.0, "z": 1.0}, {"u_100m": 25.0, "v_100m": 0.0})
    return finish(stats.power(stats.multiply(df, ["ghi"], 2), ["temperature_2m"], 2), *CELL, "time", "u_100m", "v_100m", "ghi", "temperature_2m")


@query(f"""with b as (select least(floor(value / 2.5)::int, 39) bin from events where value between 0 and 100)
select bin::bigint bin, count(*)::bigint count, {r("(bin + 0.5) * 2.5", "center")}, {r("count(*) / (sum(count(*)) over () * 2.5)", "density")} from b group by bin""")
def histogram(spark, sf_dir):
    return finish(stats.histogram(table(spark, sf_dir, "events"), "value", 0.0, 100.0, 40))


@query(f"""with p as (select quantile_cont(abs(value - 40), 0.999) lim from events), v as (select value - 40 x, lim from events, p),
b as (select least(floor((x + lim) / (2 * lim / 20))::int, 19) bin, lim from v where x between -lim and lim)
select bin::bigint bin, count(*)::bigint count from b group by bin""")
def trimmed_histogram(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("x", F.col("value") - 40)
    edge = stats.trimmed_range(df, "x", 99.9)
    return finish(stats.histogram(df, "x", -edge, edge, 20), "bin", "count")


@query(f"""select {r("sqrt(avg(value * value))", "rms")} from events""")
def root_mean_square(spark, sf_dir):
    return finish(stats.root_mean_square(table(spark, sf_dir, "events"), "value"))


@query(f"""with s as (select sum(u_100m * u_100m) a, sum(u_100m * v_100m) b, sum(v_100m * v_100m) c, sum(u_100m * temperature_2m) d, sum(v_100m * temperature_2m) e
from cube where u_100m is not null and v_100m is not null and temperature_2m is not null)
select {r("(c * d - b * e) / nullif(a * c - b * b, 0)", "w1")}, {r("(a * e - b * d) / nullif(a * c - b * b, 0)", "w2")} from s""".replace("with s", f"with {SMALL_SQL}, s", 1))
def least_squares(spark, sf_dir):
    df = cube_small(spark, sf_dir).dropna(subset=["u_100m", "v_100m", "temperature_2m"])
    return finish(stats.ols_no_intercept(df, "temperature_2m", "u_100m", "v_100m"))
