"""Queries: slices, names, registries of features, files written and read, samples, exogenous fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from .cubes import SCATTERED_SQL, SITES_SQL, SMALL_SQL, cube_small, scattered, sites, table
from .finish import finish, n, r, t
from .functions import names, scalars, times
from .operators import collect, grid, profiles, raster, sampling, standardize, windows
from .plans import features, pairs
from .queries import query
from .queries_grid import INDEXED
from .queries_raster import CELL, KEY
from .sources import scan, sinks
from .store import new_folder


def _place(spark) -> str:
    """A new folder that driver and executors share."""
    return new_folder(spark)


@query(f"""with {INDEXED} select {KEY}, {n("t_idx")}, {r("u_100m", "u_100m")} from ix where south_north >= 1 and south_north < 3 and west_east < 2 and t_idx >= 5 and t_idx < 12""")
def index_slice(spark, sf_dir):
    df = raster.time_index(cube_small(spark, sf_dir))
    return finish(raster.index_slice(df, south_north=(1, 3), west_east=(None, 2), t_idx=(5, 12)), *CELL, "t_idx", "u_100m")


@query(f"""with {SITES_SQL} select {n("best.south_north", "south_north")}, {n("best.west_east", "west_east")}
from (select arg_min(struct_pack(south_north, west_east), struct_pack(d := sqrt((latitude - 39.87) ** 2 + (longitude + 104.77) ** 2), i := south_north, j := west_east)) best from sites)""")
def closest_cell(spark, sf_dir):
    cell = raster.closest_cell(sites(spark, sf_dir), 39.87, -104.77, threshold=1.0)
    return finish(spark.createDataFrame([cell], "south_north int, west_east int"))


@query(f"""with {SMALL_SQL} select 'ghi' feature, bool_or(ghi is null) or min(ghi) = max(ghi) failed from cube union all select 'latitude', bool_or(latitude is null) or min(latitude) = max(latitude) from cube
union all select 'flat', true from (select 1)""")
def failed_output(spark, sf_dir):
    return raster.failed_output(cube_small(spark, sf_dir).withColumn("flat", F.lit(3.0)), ["ghi", "latitude", "flat"])


@query(f"""select {n("l_linenumber", "chunk_id")}, count(*)::bigint rows from lineitem where l_linenumber not in (select n_regionkey from nation) group by l_linenumber""")
def not_yet_written(spark, sf_dir):
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("chunk_id"))
    written = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("chunk_id"))
    return finish(raster.not_yet_written(chunks, written).groupBy("chunk_id").agg(F.count("*").alias("rows")))


@query(f"""select {n("p_partkey")}, {n("p_size", "lev")}, {n("dense_rank() over (order by p_size desc) - 1", "level")} from part""")
def level_index(spark, sf_dir):
    return finish(standardize.level_index(table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("lev"))), "p_partkey", "lev", "level")


@query(f"""select {n("s_suppkey", "gid")}, {r("s_acctbal", "x")}, s_name site_name from supplier""")
def renamed(spark, sf_dir):
    df = standardize.rename_known(standardize.lower_names(table(spark, sf_dir, "supplier").withColumnsRenamed({"s_suppkey": "S_SuppKey", "s_acctbal": "S_AcctBal"})), {"S_SuppKey": "gid", "S_AcctBal": "x", "s_name": "site_name"})
    return finish(df, "gid", "x", "site_name")


@query(f"""with {SMALL_SQL}, b as (select gid, time, ghi from cube where gid < 12) select {n("a.gid", "gid")}, {t("a.time")}, {r("a.u_100m", "u_100m")}, {r("b.ghi", "ghi")} from cube a left join b on a.gid = b.gid and a.time = b.time""")
def merged_features(spark, sf_dir):
    df = cube_small(spark, sf_dir)
    return finish(collect.merge_features([df.select("gid", "time", "u_100m"), df.where("gid < 12").select("gid", "time", "ghi")]), "gid", "time", "u_100m", "ghi")


@query(f"""select {n("l_suppkey", "gid")}, {t("l_shipdate", "time")}, count(*)::bigint n from lineitem group by all having count(*) > 1""")
def duplicate_steps(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("gid"), F.col("l_shipdate").alias("time"))
    return finish(collect.duplicate_steps(lines), "gid", "time", "n")


@query(f"""with {SMALL_SQL} select {KEY}, {t("time")}, {r("sqrt(u_100m ** 2 + v_100m ** 2)", "windspeed_100m")}, {r("(degrees(atan2(u_100m, v_100m)) + 360) % 360", "winddirection_100m")} from cube""")
def speed_and_direction(spark, sf_dir):
    return finish(collect.to_speed_direction(cube_small(spark, sf_dir), [("u_100m", "v_100m")]), *CELL, "time", "windspeed_100m", "winddirection_100m")


@query(f"""with {SMALL_SQL} select {KEY}, {t("time")}, {r("ghi / 9.81", "zg")}, {r("100 * v_100m", "pressure")}, {r("ghi / 9.81 - u_100m", "lev")} from cube""")
def era_heights(spark, sf_dir):
    df = cube_small(spark, sf_dir).withColumns({"z": F.col("ghi"), "level": F.col("v_100m"), "topography": F.col("u_100m")})
    return finish(profiles.height_above_ground(profiles.era_heights(df)), *CELL, "time", "zg", "pressure", "lev")


@query(f"""with p as (select month(l_shipdate) k, l_linenumber * 20.0::double lev, avg(l_quantity) v from lineitem group by all), s as (select month(l_shipdate) k, 5.0::double lev, avg(l_discount) * 100 v from lineitem group by 1),
a as (select * from p union all select * from s), b as (select k, max_by(struct_pack(lev, v), lev) filter (lev < 12.5) lo, min_by(struct_pack(lev, v), lev) filter (lev >= 12.5) hi from a group by k)
select {n("k")}, {r("lo.v + (hi.v - lo.v) * (12.5 - lo.lev) / (hi.lev - lo.lev)", "v")} from b""")
def single_levels(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("k", F.month("l_shipdate"))
    profile = lines.groupBy("k", (F.col("l_linenumber") * 20.0).alias("lev")).agg(F.avg("l_quantity").alias("v"))
    surface = lines.groupBy("k").agg((F.avg("l_discount") * 100).alias("v5"))
    both = profiles.with_single_levels(profile, surface, {5.0: "v5"}, "v", ("k",))
    return finish(profiles.interpolate(both, "v", 12.5, keys=("k",)))


@query(f"""with {SMALL_SQL}, g as (select distinct gid, latitude from cube), d as (select distinct time from cube) select {n("gid")}, {t("time")}, {r("latitude", "latitude")} from g cross join d""")
def repeated_in_time(spark, sf_dir):
    df = cube_small(spark, sf_dir)
    return finish(grid.repeat_in_time(df.select("gid", "latitude").distinct(), df.select("time").distinct()), "gid", "time", "latitude")


@query(f"""with {SMALL_SQL} select {KEY}, {t("time")}, {r("u_100m", "relativehumidity_2m")}, {r("ghi - 273.15", "temperature_2m")}, {r("v_100m - 273.15", "temperature_max_2m")},
{r("case when v_100m is null or nullif(clearsky_ghi, 0) is null then null else greatest(0, least(1, v_100m / nullif(clearsky_ghi, 0))) end", "clearsky_ratio")} from cube""")
def climate_model_features(spark, sf_dir):
    df = cube_small(spark, sf_dir).select(*CELL, "time", "clearsky_ghi", F.col("u_100m").alias("hurs"), F.col("ghi").alias("tas"), F.col("v_100m").alias("tasmax"), F.col("v_100m").alias("rsds"))
    wanted = ["relativehumidity_2m", "temperature_2m", "temperature_max_2m", "clearsky_ratio"]
    return finish(features.derive(df, wanted, registry="climate_model"), *CELL, "time", *wanted)


@query(f"""with {SMALL_SQL} select {KEY}, {t("time")}, {r("u_100m * (80 / 10.0) ** 0.2", "u_80m")}, {r("v_100m * (120 / 10.0) ** 0.2", "v_120m")} from cube""")
def power_law_features(spark, sf_dir):
    df = cube_small(spark, sf_dir).select(*CELL, "time", F.col("u_100m").alias("uas"), F.col("v_100m").alias("vas"))
    return finish(features.derive(df, ["u_80m", "v_120m"], registry="power_law"), *CELL, "time", "u_80m", "v_120m")


@query(f"""with {SMALL_SQL} select {KEY}, {t("time")}, {r("u_100m", "windspeed")}, {r("u_100m * sin(radians(ghi))", "u")}, {r("u_100m * cos(radians(ghi))", "v")}, {r("temperature_2m", "temperature_max_2m")}, {r("latitude", "latitude_feature")}, {r("v_100m + ghi", "pressure")} from cube""")
def solar_site_features(spark, sf_dir):
    df = cube_small(spark, sf_dir).select(*CELL, "time", "latitude", "temperature_2m", F.col("u_100m").alias("wind_speed"), F.col("ghi").alias("wind_direction"), F.col("v_100m").alias("p"), F.col("ghi").alias("pb"))
    wanted = ["windspeed", "u", "v", "temperature_max_2m", "latitude_feature", "pressure"]
    return finish(features.derive(df, wanted, registry="solar_sites"), *CELL, "time", *wanted)


@query(f"""with {SMALL_SQL}, nt as (select time nt_time, coalesce(bool_or(clearsky_ghi <= 5), false) night from cube group by time) select {KEY}, {t("time")}, {r("case when not night then (ghi < clearsky_ghi)::int end", "cloud_mask")} from cube join nt on nt_time = time""")
def cloud_mask(spark, sf_dir):
    df = raster.night(cube_small(spark, sf_dir), least=5.0)
    return finish(features.derive(df, ["cloud_mask"]), *CELL, "time", "cloud_mask")


@query(f"""select {n("o_orderkey")}, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') text, {t("o_orderdate", "time")}, (month(o_orderdate) = 2 and day(o_orderdate) = 29) leap from orders""")
def time_texts(spark, sf_dir):
    when = F.col("o_orderdate").cast("timestamp")
    df = table(spark, sf_dir, "orders").select("o_orderkey", times.encode(when).alias("text"), times.leap_day(when).alias("leap"))
    return finish(df.withColumn("time", times.decode(F.col("text"))), "o_orderkey", "text", "time").join(df.select("o_orderkey", "leap"), "o_orderkey")


@query(f"""with g as (select c_custkey // 10 south_north, c_custkey % 10 west_east, (170 + (c_custkey % 10) * 4 + 180) % 360 - 180 longitude from customer) select {n("south_north")}, {n("west_east")}, {r("(longitude + 360) % 360", "longitude")} from g""")
def rising_longitudes(spark, sf_dir):
    """A grid across the date line."""
    k = F.col("c_custkey")
    df = table(spark, sf_dir, "customer").select(F.floor(k / 10).alias("south_north"), F.pmod(k, F.lit(10)).alias("west_east"), (F.pmod(170 + F.pmod(k, F.lit(10)) * 4 + 180, F.lit(360)) - 180).cast("double").alias("longitude"))
    return finish(grid.rising_longitudes(df), *CELL, "longitude")


@query("""select strftime(ts, '%Y-%m-%d 00:00:00') date, min(hour(ts))::bigint "first", max(hour(ts))::bigint "last" from events where event_type = 'purchase' and value is not null group by 1""")
def daylight(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("time"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("clearsky_ratio"))
    return finish(windows.daylight(df), "date", "first", "last")


@query(f"""with {SMALL_SQL} select {KEY}, {t("time")}, {r("u_100m", "u_100m")}, {r("ghi", "ghi")} from cube""")
def written_features(spark, sf_dir):
    """Features written one by one, found again as cached, read side by side."""
    pattern = f"{_place(spark)}/{{feature}}.parquet"
    keys = [*CELL, "time"]
    sinks.write_features(cube_small(spark, sf_dir), pattern, ["u_100m"], keys)
    sinks.write_features(cube_small(spark, sf_dir), pattern, ["u_100m", "ghi"], keys)
    have, missing = scan.cached(spark, pattern, ["u_100m", "ghi", "v_100m"])
    assert (have, missing) == (["u_100m", "ghi"], ["v_100m"])
    return finish(scan.read_cached(spark, pattern, have, keys), *keys, "u_100m", "ghi")


@query(f"""with {SMALL_SQL} select {n("south_north % 2", "part")}, {KEY}, {t("time")}, {r("case when u_100m is not null then least(greatest(u_100m * 3, -120), 120) end", "u_100m")} from cube""")
def written_output(spark, sf_dir):
    """A result held to its limits, partitioned, scanned again by extension."""
    path = f"{_place(spark)}.parquet"
    df = cube_small(spark, sf_dir).select((F.col("south_north") % 2).alias("part"), *CELL, "time", (F.col("u_100m") * 3).alias("u_100m"))
    sinks.write_output(df, path, ["u_100m"], partition=["part"])
    return finish(scan.scan(spark, path, features=["part", "u_100m"]), "part", *CELL, "time", "u_100m")


@query(f"""select {n("s_suppkey", "gid")}, {r("s_acctbal / 1000", "scalar")}, {r("1", "adder")} from supplier where s_acctbal < 0""")
def written_factors(spark, sf_dir):
    """Bias factors written with their settings; only wanted sites read."""
    path = _place(spark)
    suppliers = table(spark, sf_dir, "supplier")
    sinks.write_factors(suppliers.select(F.col("s_suppkey").alias("gid"), (F.col("s_acctbal") / 1000).alias("scalar"), F.lit(1.0).alias("adder")), path, {"feature": "x"})
    assert sinks.read_meta(spark, path) == {"feature": "x"}
    return finish(scan.bias_factors(spark, path, ["scalar", "adder"], suppliers.where("s_acctbal < 0").select(F.col("s_suppkey").alias("gid"))), "gid", "scalar", "adder")


@query(f"""with {SMALL_SQL} select {n("gid")}, {t("time")}, {r("u_100m", "u_100m")}, {r("case when gid >= 6 then ghi end", "ghi")} from cube""")
def chunk_files(spark, sf_dir):
    """Chunks of different columns written apart and read as one."""
    base, df = _place(spark), cube_small(spark, sf_dir)
    df.where("gid < 6").select("gid", "time", "u_100m").write.parquet(f"{base}_000000_000000.parquet")
    df.where("gid >= 6").select("gid", "time", "u_100m", "ghi").write.parquet(f"{base}_000000_000001.parquet")
    return finish(collect.read_chunks(spark, [f"{base}_000000_000000.parquet", f"{base}_000000_000001.parquet"]), "gid", "time", "u_100m", "ghi")


@query(f"""with {SITES_SQL}, la as (select distinct latitude from sites), lo as (select distinct longitude from sites)
select {n("dense_rank() over (order by latitude desc) - 1", "south_north")}, {n("dense_rank() over (order by longitude) - 1", "west_east")}, {r("latitude", "latitude")}, {r("longitude", "longitude")} from la cross join lo""")
def grid_from_axes(spark, sf_dir):
    s = sites(spark, sf_dir)
    return finish(scan.grid_from_axes(s.select("latitude").distinct(), s.select("longitude").distinct()), *CELL, "latitude", "longitude")


@query(f"""with {SCATTERED_SQL}, {SITES_SQL}, pr as (select p.gid sid, s.gid tid, sqrt((p.latitude - s.latitude) ** 2 + (p.longitude - s.longitude) ** 2) d from pts p cross join sites s),
b as (select sid, arg_min(tid, struct_pack(d := d, t := tid)) tid from pr where d < 0.04 group by sid), m as (select tid, avg(x) x from b join pts on pts.gid = sid group by tid),
c as (select s.gid, south_north, west_east, x from sites s left join m on tid = s.gid), ok as (select * from c where x is not null),
nn as (select c.gid, arg_min(ok.x, struct_pack(d := sqrt((c.south_north - ok.south_north) ** 2 + (c.west_east - ok.west_east) ** 2), i := ok.south_north, j := ok.west_east)) y from c cross join ok where c.x is null group by c.gid)
select {n("c.gid", "gid")}, {n("south_north")}, {n("west_east")}, {r("coalesce(x, y) * 0.5", "x")} from c left join nn on nn.gid = c.gid""")
def exogenous_field(spark, sf_dir):
    return finish(pairs.exo_field(scattered(spark, sf_dir), sites(spark, sf_dir, exact=True), "x", 0.04, 0.5), "gid", *CELL, "x")


@query(f"""with {INDEXED}, lo as (select south_north // 2 i, west_east // 2 j, t_idx // 3 k, avg(u_100m) u from ix group by all) select {KEY}, {n("t_idx")}, {r("u_100m", "u_100m")}, {r("u", "u_100m_low")} from ix join lo on i = south_north // 2 and j = west_east // 2 and k = t_idx // 3""")
def aligned_samples(spark, sf_dir):
    high = raster.time_index(cube_small(spark, sf_dir)).select(*CELL, "t_idx", "u_100m")
    keys = [F.floor(F.col(c) / s).cast("int").alias(c) for c, s in (("south_north", 2), ("west_east", 2), ("t_idx", 3))]
    return finish(sampling.align(high.groupBy(*keys).agg(F.avg("u_100m").alias("u_100m")), high, ["u_100m"], 2, 3), *CELL, "t_idx", "u_100m", "u_100m_low")


@query("""with f as (select event_type || '_' || h || 'm' as name, event_type, h from (select distinct event_type from events), unnest([10, 100]) t(h)),
c as (select event_type, count(*) n from events group by 1),
chosen as (select 'choose' kind, name, event_type from f where h = 100 and event_type like '%c%' union all select 'union', name, event_type from f where h = 100
union all select 'snake', 'wind_' || event_type, event_type from f where h = 10)
select kind, name, n::bigint events from chosen join c on c.event_type = chosen.event_type""")
def feature_lists(spark, sf_dir):
    """Names of features made from the kinds of events, chosen by pattern, united and rewritten, with their numbers of events."""
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("events"))
    kinds = sorted(r[0] for r in counts.select("event_type").collect())
    given = [f"{k}_{h}m" for k in kinds for h in (10, 100)]
    found = {
        "choose": [(x, x.rpartition("_")[0]) for x in names.choose(given, ["*c*_100m"])],
        "union": [(x, x.rpartition("_")[0]) for x in names.union_in_order(names.choose(given, ["*_100m"]), [f"{kinds[0]}_100m"])],
        "snake": [(names.snake("Wind" + k.capitalize()), k) for k in kinds],
    }
    rows = spark.createDataFrame([(kind, name, of) for kind, pairs_ in found.items() for name, of in pairs_], "kind string, name string, event_type string")
    return finish_text(rows.join(counts, "event_type"))


def finish_text(df):
    return df.select("kind", "name", F.col("events").cast("long").alias("events"))


@query(f"""with {SMALL_SQL} select {KEY}, {t("time")}, {r("case when u_100m * 3 between -120 and 120 then u_100m * 3 end", "inside")} from cube""")
def outside_limits(spark, sf_dir):
    """Values outside their feature's limits taken out, to be filled from neighbours."""
    return finish(cube_small(spark, sf_dir).withColumn("inside", scalars.enforce("u_100m", F.col("u_100m") * 3, drop=True)), *CELL, "time", "inside")
