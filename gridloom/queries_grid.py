"""Queries: windows along time, neighbours, profiles, refinement, chunks, stitching."""

from __future__ import annotations

from pyspark.sql import functions as F

from .cubes import HISTORY_SQL, SCATTERED_SQL, SITES_SQL, SMALL_SQL, WIDE_SQL, cube_small, cube_wide, histories, in_debt, of_nations, placed, scattered, sites, table
from .finish import finish, n, r, t
from .functions import times as T
from .operators import chunks, collect, grid, neighbors, profiles, raster, sampling, windows
from .queries import query
from .queries_raster import CELL, KEY, PMOD
from .store import dealt

INDEXED = f"{SMALL_SQL}, ix as (select *, dense_rank() over (order by time) - 1 t_idx, (select count(distinct time) from cube) len from cube)"


def _indexed(spark, sf_dir):
    return raster.time_index(cube_small(spark, sf_dir))


@query(f"""with {INDEXED} select {n("a.south_north", "south_north")}, {n("a.west_east", "west_east")}, {n("a.t_idx", "t_idx")}, {r("b.u_100m", "u_100m")}, {t("a.time + interval 90 minute")}
from ix a join ix b on a.south_north = b.south_north and a.west_east = b.west_east and {PMOD.format("(b.t_idx + 7)", "b.len")} = a.t_idx""")
def rolled(spark, sf_dir):
    df = _indexed(spark, sf_dir)
    length = df.select("time").distinct().count()
    return finish(windows.shift_time(windows.roll(df, ["u_100m"], 7, length), 90), *CELL, "t_idx", "u_100m", "time")


@query(f"""with {INDEXED} select {n("a.south_north", "south_north")}, {n("a.west_east", "west_east")}, {n("a.t_idx", "t_idx")}, {r("case when a.t_idx < 6 then f.u_100m else b.u_100m end", "u_100m")}
from ix a join ix b on a.south_north = b.south_north and a.west_east = b.west_east and b.t_idx = {PMOD.format("(a.t_idx - 6)", "a.len")}
join ix f on a.south_north = f.south_north and a.west_east = f.west_east and f.t_idx = 0""")
def rolled_to_utc(spark, sf_dir):
    df = _indexed(spark, sf_dir)
    length = df.select("time").distinct().count()
    return finish(windows.roll_to_utc(df, "u_100m", -6, length), *CELL, "t_idx", "u_100m")


@query(f"""with {SMALL_SQL} select {KEY}, {t("time")}, {r("u_100m - lag(u_100m) over (partition by south_north, time order by west_east)", "across")},
{r(PMOD.format("v_100m * 9 - lag(v_100m * 9, 2) over (partition by south_north, west_east order by time) + 180", 360) + " - 180", "along")} from cube""")
def differences(spark, sf_dir):
    df = windows.difference(cube_small(spark, sf_dir), "u_100m", "west_east", ("south_north", "time")).withColumn("w", F.col("v_100m") * 9)
    df = windows.difference(df, "w", "time", CELL, 2, 360.0)
    return finish(df.withColumnsRenamed({"u_100m_diff": "across", "w_diff": "along"}), *CELL, "time", "across", "along")


@query(f"""with {SMALL_SQL} select {KEY}, {t("time")}, {r('''case when lag(south_north) over w is null then lead(ghi) over w - ghi when lead(south_north) over w is null then ghi - lag(ghi) over w
else (lead(ghi) over w - lag(ghi) over w) / 2 end''', "slope")} from cube window w as (partition by west_east, time order by south_north)""")
def derivative(spark, sf_dir):
    return finish(windows.derivative(cube_small(spark, sf_dir), "ghi", "south_north", ("west_east", "time")).withColumnRenamed("ghi_d_south_north", "slope"), *CELL, "time", "slope")


@query(f"""with {WIDE_SQL}, ix as (select *, dense_rank() over (order by time) - 1 t_idx from wide), v as (select south_north, west_east, t_idx, u_100m from ix where u_100m is not null),
p as (select x.south_north, x.west_east, x.t_idx, x.u_100m,
 (select max(v.t_idx) from v where v.south_north = x.south_north and v.west_east = x.west_east and v.t_idx < x.t_idx) t0, (select min(v.t_idx) from v where v.south_north = x.south_north and v.west_east = x.west_east and v.t_idx > x.t_idx) t1 from ix x),
q as (select p.*, (select max(v.t_idx) from v where v.south_north = p.south_north and v.west_east = p.west_east and v.t_idx < p.t0) tt0, (select min(v.t_idx) from v where v.south_north = p.south_north and v.west_east = p.west_east and v.t_idx > p.t1) tt1 from p),
j as (select q.*, a.u_100m x0, b.u_100m x1, c.u_100m xx0, d.u_100m xx1 from q left join v a on a.south_north = q.south_north and a.west_east = q.west_east and a.t_idx = t0
 left join v b on b.south_north = q.south_north and b.west_east = q.west_east and b.t_idx = t1 left join v c on c.south_north = q.south_north and c.west_east = q.west_east and c.t_idx = tt0
 left join v d on d.south_north = q.south_north and d.west_east = q.west_east and d.t_idx = tt1)
select {KEY}, {n("t_idx")}, {r('''coalesce(u_100m, case when t1 is null then coalesce(xx0 + (t_idx - tt0) * (x0 - xx0) / (t0 - tt0), x0) when t0 is null then coalesce(x1 + (t_idx - t1) * (xx1 - x1) / (tt1 - t1), x1)
 else x0 + (t_idx - t0) * (x1 - x0) / (t1 - t0) end)''', "u_100m")} from j""")
def gaps_filled(spark, sf_dir):
    return finish(windows.interpolate_na(raster.time_index(cube_wide(spark, sf_dir)), "u_100m"), *CELL, "t_idx", "u_100m")


def _gauss(sigma: float) -> str:
    rows = ", ".join(f"({k}, {w!r}::double)" for k, w in windows.gaussian_weights(sigma))
    return f"gw as (select * from (values {rows}) g(k, w))"


@query(f"""with {SMALL_SQL}, {_gauss(0.8)}, f as (select south_north i, west_east j, time, coalesce(u_100m, 0) x from cube),
a as (select i.i, f.j, f.time, sum(f.x * w) x from (select distinct i from f) i cross join gw join f on f.i = least(greatest(i.i + k, 0), 3) group by i.i, f.j, f.time),
b as (select a.i, j.j, a.time, sum(a.x * w) x from (select distinct j from f) j cross join gw join a on a.j = least(greatest(j.j + k, 0), 3) group by a.i, j.j, a.time)
select {n("i", "south_north")}, {n("j", "west_east")}, {t("time")}, {r("x", "u_100m")} from b""")
def smoothed(spark, sf_dir):
    df = cube_small(spark, sf_dir).select(*CELL, "time", F.coalesce("u_100m", F.lit(0.0)).alias("u_100m"))
    return finish(windows.smooth(df, "u_100m", 0.8, 4, 4), *CELL, "time", "u_100m")


@query(f"""with {WIDE_SQL}, x as (select south_north i, west_east j, time, temperature_2m v from wide),
b as (select x.i, x.j, x.time, arg_min(y.v, struct_pack(d := sqrt((x.i - y.i) ** 2 + (x.j - y.j) ** 2), i := y.i, j := y.j)) v from x join x y on x.time = y.time and y.v is not null where x.v is null group by x.i, x.j, x.time)
select {n("x.i", "south_north")}, {n("x.j", "west_east")}, {t("x.time")}, {r("coalesce(x.v, b.v)", "temperature_2m")} from x left join b on x.i = b.i and x.j = b.j and x.time = b.time""")
def nearest_filled(spark, sf_dir):
    return finish(windows.fill_nearest(cube_wide(spark, sf_dir), "temperature_2m"), *CELL, "time", "temperature_2m")


@query(f"""with {SMALL_SQL}, p as (select unnest(range(-3, 7)) i) select {n("p.i", "south_north")}, {n("west_east")}, {t("time")}, {r("u_100m", "u_100m")}
from p join cube on south_north = least({PMOD.format("p.i", 6)}, 6 - {PMOD.format("p.i", 6)})""")
def mirrored(spark, sf_dir):
    return finish(windows.pad_reflect(cube_small(spark, sf_dir), "south_north", 4, 3, 3), *CELL, "time", "u_100m")


@query(f"""with l as (select l_suppkey gid, dayofyear(l_shipdate) d, avg(l_quantity) loss from lineitem group by all)
select {n("gid")}, {n("d", "epoch")}, {r("avg(loss) over (partition by gid order by d rows 4 preceding)", "loss_mean")} from l""")
def running_mean(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("gid"), F.dayofyear("l_shipdate").alias("epoch")).agg(F.avg("l_quantity").alias("loss"))
    return finish(windows.running_mean(df, "loss", "epoch", 5, ("gid",)), "gid", "epoch", "loss_mean")


@query(f"""with l as (select l_suppkey gid, dayofyear(l_shipdate) d, avg(l_quantity) x from lineitem group by all), c as (select gid, d, abs(x - lag(x) over (partition by gid order by d)) c, row_number() over (partition by gid order by d desc) k from l)
select {n("gid")}, coalesce(bool_and(c < 12) and count(c) = 3, false) stop from c where k <= 3 group by gid""")
def early_stop(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("gid"), F.dayofyear("l_shipdate").alias("epoch")).agg(F.avg("l_quantity").alias("loss"))
    return finish(windows.early_stop(df, "loss", "epoch", 3, 12.0, ("gid",)))


NEAR = f"""{SITES_SQL}, {SCATTERED_SQL}, pr as (select p.gid sid, s.gid tid, sqrt((p.latitude - s.latitude) ** 2 + (p.longitude - s.longitude) ** 2) distance, x from pts p cross join sites s)"""


@query(f"""with {NEAR}, b as (select sid, arg_min(tid, struct_pack(d := distance, t := tid)) tid, min(distance) distance from pr where distance < 0.12 group by sid)
select {n("gid", "sid")}, {n("coalesce(tid, -1)", "tid")}, {r("distance", "distance")} from pts left join b on gid = sid""")
def nearest_site(spark, sf_dir):
    return finish(neighbors.nn_join(scattered(spark, sf_dir), sites(spark, sf_dir, exact=True), 0.12).fillna(-1, ["tid"]))


@query(f"with {NEAR} select {n('sid')}, {n('arg_min(tid, struct_pack(d := distance, t := tid))', 'tid')}, {r('min(distance)', 'distance')} from pr group by sid")
def nearest_site_anywhere(spark, sf_dir):
    return finish(neighbors.nearest(scattered(spark, sf_dir), sites(spark, sf_dir, exact=True), 0.03))


@query(f"""with {NEAR}, k as (select sid, tid, distance, row_number() over (partition by sid order by distance, tid) rank from pr where distance < 0.2) select {n("sid")}, {n("tid")}, {r("distance", "distance")}, {n("rank")} from k where rank <= 3""")
def nearest_sites(spark, sf_dir):
    return finish(neighbors.knn_join(scattered(spark, sf_dir), sites(spark, sf_dir, exact=True), 3, 0.2))


@query(f"""with {SITES_SQL}, d as (select south_north, west_east, abs(latitude - lag(latitude) over (partition by west_east order by south_north)) a, abs(longitude - lag(longitude) over (partition by south_north order by west_east)) o from sites)
select {r("greatest((select max(m) from (select quantile_cont(a, 0.5) m from d group by west_east)), (select max(m) from (select quantile_cont(o, 0.5) m from d group by south_north)))", "bound")}""")
def default_bound(spark, sf_dir):
    return finish(neighbors.default_bound(sites(spark, sf_dir)))


@query(f"""with {NEAR}, b as (select sid, arg_min(tid, struct_pack(d := distance, t := tid)) tid from pr where distance < 0.12 group by sid), m as (select tid, avg(x) x from b join pts on gid = sid group by tid)
select {n("gid")}, {r("x", "x")} from sites left join m on gid = tid""")
def group_mean(spark, sf_dir):
    return finish(neighbors.group_mean(scattered(spark, sf_dir), sites(spark, sf_dir, exact=True), ["x"], 0.12))


@query(f"""with {SITES_SQL}, o as (select l_suppkey % 20 + 100000 gid, 40 - 0.0713 * (l_suppkey % 20) latitude, -104.95 + 0.0191 * (l_suppkey % 20) longitude, date_trunc('year', l_shipdate) as time, l_quantity x from lineitem),
pr as (select o.gid sid, s.gid tid, sqrt((o.latitude - s.latitude) ** 2 + (o.longitude - s.longitude) ** 2) d from (select distinct gid, latitude, longitude from o) o cross join sites s),
b as (select sid, arg_min(tid, struct_pack(d := d, t := tid)) tid from pr where d < 0.1 group by sid), m as (select tid, time, avg(x) x from b join o on o.gid = sid group by tid, time),
g as (select s.gid, y.time, x from sites s cross join (select distinct time from o) y left join m on m.tid = s.gid and m.time = y.time)
select {n("gid")}, {t("time")}, {r("x", "x_obs")}, {r("(select count(x) / count(*)::double from g)", "cover")} from g""")
def observation_raster(spark, sf_dir):
    k = F.pmod("l_suppkey", F.lit(20))
    obs = table(spark, sf_dir, "lineitem").select((k + 100000).alias("gid"), placed("40", "-0.0713", k).alias("latitude"), placed("-104.95", "0.0191", k).alias("longitude"), F.date_trunc("year", "l_shipdate").alias("time"), F.col("l_quantity").alias("x_obs"))
    raster_ = neighbors.group_mean(obs, sites(spark, sf_dir, exact=True), ["x_obs"], 0.1, by_time=True)
    return finish(raster_.crossJoin(F.broadcast(neighbors.observation_cover(raster_, "x_obs"))), "gid", "time", "x_obs", "cover")


@query(f"""with {SITES_SQL} select {n("gid")} from sites where gid in (select s_suppkey from supplier where s_nationkey < 12)""")
def same_places(spark, sf_dir):
    meta = sites(spark, sf_dir)
    wanted = meta.join(of_nations(spark, sf_dir), "gid", "left_semi").select("gid", (F.col("latitude") + 0.00003).alias("latitude"), "longitude")
    return finish(neighbors.same_places(meta, wanted).select("gid"))


@query(f"""with {SITES_SQL} select {n("gid")} from sites where gid in (select s_suppkey from supplier where s_acctbal < 0)""")
def same_places_in_debt(spark, sf_dir):
    """The places of suppliers in debt."""
    meta = sites(spark, sf_dir)
    wanted = meta.join(in_debt(spark, sf_dir), "gid", "left_semi").select("gid", (F.col("latitude") + 0.00003).alias("latitude"), "longitude")
    return finish(neighbors.same_places(meta, wanted).select("gid"))


@query(f"""with {NEAR}, k as (select sid, tid, distance, row_number() over (partition by tid order by distance, sid) rank from pr where distance < 0.2), w as (select k.tid, 1 / greatest(distance, 1e-9) w, x from k join pts on gid = sid where rank <= 4)
select {n("tid", "cell")}, {r("sum(w * x) / sum(w)", "x", 4)} from w group by tid""")
def regridded(spark, sf_dir):
    return finish(neighbors.regrid(scattered(spark, sf_dir), sites(spark, sf_dir, exact=True), ["x"], 4, 0.2), digits=4)


WINDOWS_SQL = ", ".join(f"({i}, {c!r}::double)" for i, c in enumerate(T.window_centers(24)))


@query(f"""with w as (select * from (values {WINDOWS_SQL}) v(t_window, c)), d as (select dayofyear(o_orderdate) doy, count(*) placed from orders group by 1)
select {n("t_window")}, {r("c", "center")}, {n("doy")}, {n("placed")} from w, d
where case when c - 60 < 0 then doy > 365 + c - 60 or doy < c + 60 when c + 60 > 365 then doy > c - 60 or doy < c + 60 - 365 else doy > c - 60 and doy < c + 60 end""")
def window_days(spark, sf_dir):
    """Days with orders in each window of the year that they belong to."""
    from .operators.bias import window_days as days

    placed = table(spark, sf_dir, "orders").groupBy(F.dayofyear("o_orderdate").alias("doy")).agg(F.count("*").alias("placed"))
    return finish(placed.join(F.broadcast(days(spark)), "doy"), "t_window", "center", "doy", "placed")


@query(f"""with w as (select * from (values {WINDOWS_SQL}) v(t_window, c)), o as (select distinct dayofyear(o_orderdate) doy from orders)
select {n("doy")}, {n("arg_min(t_window, struct_pack(d := abs(doy - c), i := t_window))", "t_window")} from o, w group by doy""")
def nearest_window(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.dayofyear("o_orderdate").alias("doy")).distinct()
    return finish(df.withColumn("t_window", T.nearest_window(F.col("doy"), 24)))


@query(f"""with {SMALL_SQL}, low as (select south_north // 2 i, west_east // 2 j, time, avg(u_100m) u_low from cube group by 1, 2, 3)
select {KEY}, {t("cube.time")}, {r("u_100m - u_low", "mom1_sf", 10)}, {r("u_100m * u_100m", "mom2_sep", 10)}, {r("(u_100m - 1) ** 2", "mom2", 10)}, {r("(u_100m - u_low - 1) ** 2", "mom2_sf", 10)}, {r("(u_100m - u_low) ** 2", "mom2_sep_sf", 10)}
from cube join low on south_north // 2 = i and west_east // 2 = j and cube.time = low.time""")
def moment_targets(spark, sf_dir):
    from .operators.coarsen import spatial

    df = _indexed(spark, sf_dir)
    low = spatial(df, ["u_100m"], 2, by=("t_idx",), strict=False)
    both = sampling.moment_targets(sampling.align(low, df, ["u_100m"], 2, 1).withColumn("e", F.lit(1.0)), "u_100m", "e")
    return finish(both, *CELL, "time", "mom1_sf", "mom2_sep", "mom2", "mom2_sf", "mom2_sep_sf", digits=10)


PROFILE = """prof as (select o_orderkey k, l_linenumber * 20.0 - 10 lev, l_quantity v from orders join lineitem on l_orderkey = o_orderkey),
one as (select k, lev, avg(v) v from prof group by k, lev),
b as (select k, list(struct_pack(lev := lev, v := v) order by lev desc) filter (lev < 45) b, list(struct_pack(lev := lev, v := v) order by lev) filter (lev >= 45) a from one group by k),
pq as (select k, coalesce(b[1], a[2], a[1]) p, coalesce(a[1], b[2], b[1]) q from b)"""


def _profile(spark, sf_dir):
    lines = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey")
    lines = lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), F.col("l_orderkey") == F.col("k"))
    return lines.groupBy("k", (F.col("l_linenumber") * 20.0 - 10).alias("lev")).agg(F.avg("l_quantity").alias("v"))


@query(f"""with {PROFILE} select {n("k")}, {r("case when abs(q.lev - p.lev) < 1e-3 then p.v else p.v + (q.v - p.v) * (45 - p.lev) / (q.lev - p.lev) end", "v")} from pq""")
def level_linear(spark, sf_dir):
    return finish(profiles.interpolate(_profile(spark, sf_dir), "v", 45.0, keys=("k",)))


@query(f"""with {PROFILE}, s as (select k, least(p.lev, q.lev) h0, greatest(p.lev, q.lev) h1, case when p.lev < q.lev then p.v else q.v end v0, case when p.lev < q.lev then q.v else p.v end v1 from pq)
select {n("k")}, {r("case when 45 < h0 then -1 else 1 end * case when h1 = h0 then 0 else (v1 - v0) / ln(h1 - h0 + 1) end * ln(abs(45 - h0) + 1) + v0", "v")} from s""")
def level_log(spark, sf_dir):
    return finish(profiles.interpolate(_profile(spark, sf_dir), "v", 45.0, "log", keys=("k",)))


@query(f"""with {PROFILE}, e as (select k, min(lev) lo, max(lev) hi from one group by k) select count(*)::bigint cells, count(*) filter (lo > 45 or hi < 45)::bigint not_covered, 0::bigint with_gaps from e""")
def level_check(spark, sf_dir):
    return finish(profiles.check_levels(_profile(spark, sf_dir), 45.0, ("k",)))


@query(f"""with {SMALL_SQL} select {n("south_north * 2 + a", "south_north")}, {n("west_east * 2 + b", "west_east")}, {n("gid", "low_gid")}, {n("(south_north * 2 + a) * 8 + west_east * 2 + b", "gid")}, {t("time")}, {r("u_100m", "u_100m")}
from cube, unnest([0, 1]) x(a), unnest([0, 1]) y(b)""")
def repeated_cells(spark, sf_dir):
    df = cube_small(spark, sf_dir).withColumnRenamed("gid", "low_gid")
    return finish(grid.unflatten(grid.flatten(grid.repeat_cells(df, 2), 8), 8), *CELL, "low_gid", "gid", "time", "u_100m")


@query(f"""with {INDEXED}, s as (select *, lead(ghi) over w - ghi up, ghi - lag(ghi) over w down, lead(t_idx) over w nx from ix window w as (partition by south_north, west_east order by t_idx))
select {KEY}, {n("t_idx * 3 + k", "t_idx")}, {r("ghi + case when nx is null then coalesce(down, 0) else up end * k / 3.0", "ghi")} from s, unnest([0, 1, 2]) x(k)""")
def refined_in_time(spark, sf_dir):
    return finish(grid.refine_time(_indexed(spark, sf_dir), ["ghi"], 3), *CELL, "t_idx", "ghi")


def _axis(length: int, factor: int) -> str:
    rows = ", ".join(f"({k}, {low}, {w!r}::double)" for k, low, w in grid._targets(length, factor, True))
    return f"(values {rows})"


@query(f"""with {INDEXED}, a as (select * from {_axis(4, 2)} v(k, l, w)),
x as (select a.k i, west_east j, t_idx, sum(case when south_north = l then (1 - w) * temperature_2m else w * temperature_2m end) v from ix join a on south_north in (l, l + 1) group by 1, 2, 3),
y as (select i, a.k j, t_idx, sum(case when j = l then (1 - w) * v else w * v end) v from x join a on j in (l, l + 1) group by i, a.k, t_idx)
select {n("i", "south_north")}, {n("j", "west_east")}, {n("t_idx")}, {r("v", "temperature_2m")} from y""")
def refined_in_space(spark, sf_dir):
    df = _indexed(spark, sf_dir)
    return finish(grid.interpolate(df, "temperature_2m", 4, 4, 30, 2, 1), *CELL, "t_idx", "temperature_2m")


EXTENT = f"{SITES_SQL}, g as (select max(south_north) + 1 rw, max(west_east) + 1 cl from sites)"


@query(f"""with {EXTENT} select {n("i", "south_north")}, {n("j", "west_east")}, {r("40 - 0.1 * ((i + 0.5) / 3 - 0.5)", "latitude")}, {r("-105 + 0.1 * ((j + 0.5) / 3 - 0.5)", "longitude")} from g, unnest(range(0, 3 * rw)) a(i), unnest(range(0, 3 * cl)) b(j)""")
def fine_coordinates(spark, sf_dir):
    cells = sites(spark, sf_dir)
    size = grid.describe(cells).first()
    return finish(grid.fine_coordinates(cells, size["rows"], size["columns"], 3))


@query(f"""with {EXTENT} select {n("i", "south_north")}, {n("j", "west_east")}, {r("40 - 0.1 * i", "latitude")}, {r("-105 + 0.1 * j", "longitude")} from g, unnest(range(-1, rw + 1)) a(i), unnest(range(-1, cl + 1)) b(j)""")
def padded_coordinates(spark, sf_dir):
    cells = sites(spark, sf_dir)
    size = grid.describe(cells).first()
    return finish(grid.pad_coordinates(cells, size["rows"], size["columns"]), *CELL, "latitude", "longitude")


@query(f"with {SITES_SQL}, g as (select max(south_north) + 1 rw, max(west_east) + 1 cl from sites) select {n('rw', 'rows')}, {n('cl', 'columns')}, {r('40 - 0.1 * (rw - 1)', 'target_lat')}, {r('-105', 'target_lon')}, true regular from g")
def grid_facts(spark, sf_dir):
    s = sites(spark, sf_dir)
    return finish(grid.describe(s).crossJoin(grid.is_regular(s)))


@query(f"""with {INDEXED}, i as (select i.i, c.c from unnest([0, 1]) c(c), unnest(range(c.c * 2 - 1, c.c * 2 + 3)) i(i)), k as (select i.i, c.c from unnest(range(0, 5)) c(c), unnest(range(c.c * 6 - 2, c.c * 6 + 8)) i(i))
select {n("(a.c * 2 + b.c) * 5 + k.c", "chunk_id")}, count(*)::bigint rows, {r("coalesce(sum(u_100m), 0)", "total")}, min(a.i - a.c * 2 + 1)::bigint i0, max(k.i - k.c * 6 + 2)::bigint t1 from i a, i b, k, ix
where south_north = least({PMOD.format("a.i", 6)}, 6 - {PMOD.format("a.i", 6)}) and west_east = least({PMOD.format("b.i", 6)}, 6 - {PMOD.format("b.i", 6)}) and t_idx = least({PMOD.format("k.i", 58)}, 58 - {PMOD.format("k.i", 58)}) group by a.c, b.c, k.c""")
def halo_chunks(spark, sf_dir):
    layout = chunks.Layout((4, 4, 30), (2, 2, 6), (1, 1, 2))
    sent = chunks.with_halo(_indexed(spark, sf_dir), layout)
    return finish(sent.groupBy("chunk_id").agg(F.count("*").alias("rows"), F.coalesce(F.sum("u_100m"), F.lit(0.0)).alias("total"), F.min("i").alias("i0"), F.max("t").alias("t1")))


@query(f"""with {INDEXED} select {KEY}, {n("t_idx")}, {r("u_100m * 2 + coalesce(v_100m, 0)", "y")} from ix where u_100m is not null""")
def forward_pass(spark, sf_dir):
    """A pointwise model by padded chunks gives what it gives on the whole."""
    import numpy as np

    df = _indexed(spark, sf_dir)
    layout = chunks.Layout((4, 4, df.select("time").distinct().count()), (2, 2, 7), (1, 1, 1))
    return finish(chunks.forward_pass(df, ["u_100m", "v_100m"], layout, lambda c: (c[..., :1] * 2 + np.nan_to_num(c[..., 1:])), ["y"]).where(F.col("y").isNotNull() & ~F.isnan("y")), *CELL, "t_idx", "y")


@query(f"""with {SMALL_SQL}, m as (select south_north * 2 + west_east // 2 s_chunk, bool_and(latitude < 39.2) masked from (select distinct south_north // 2 south_north, west_east, latitude from cube) group by 1) select {n("s_chunk")} from m where masked""")
def masked_chunks(spark, sf_dir):
    cells = cube_small(spark, sf_dir).withColumns({"s_chunk": F.floor(F.col("south_north") / 2) * 2 + F.floor(F.col("west_east") / 2), "mask": F.col("latitude") < 39.2})
    return finish(raster.masked_chunks(cells))


@query(f"""with {HISTORY_SQL}, u as (select * from base union all select * from bias union all select * from base), k as (select distinct gid, time from u) select {n("gid")}, count(*)::bigint steps, {t("min(time)", "first")} from k group by gid""")
def stitched(spark, sf_dir):
    base, bias, _ = histories(spark, sf_dir)
    done = collect.combine([base, bias, base])
    return finish(done.groupBy("gid").agg(F.count("*").alias("steps"), F.min("time").alias("first")))


@query(f"""with f as (select 'out_' || lpad((p_partkey % 4)::varchar, 6, '0') || '_' || lpad((p_size)::varchar, 6, '0') || '.parquet' f from part) select {n("regexp_extract(f, '_([0-9]{6})_([0-9]{6})', 1)::int", "t_chunk")}, {n("regexp_extract(f, '_([0-9]{6})_([0-9]{6})', 2)::int", "s_chunk")}, count(*)::bigint files from f group by f""".replace("{6}", "{6}"))
def chunks_of_files(spark, sf_dir):
    pad = lambda c: F.lpad(c.cast("string"), 6, "0")
    name = F.concat(F.lit("out_"), pad(F.pmod("p_partkey", F.lit(4))), F.lit("_"), pad(F.col("p_size")), F.lit(".parquet"))
    t_chunk, s_chunk = collect.chunk_of_file(name)
    return finish(table(spark, sf_dir, "part").groupBy(t_chunk.alias("t_chunk"), s_chunk.alias("s_chunk")).agg(F.count("*").alias("files")))


@query(f"""select {n("s_suppkey")}, {n("ntile(7) over (order by s_suppkey) - 1", "node")} from supplier""")
def split_evenly(spark, sf_dir):
    return finish(grid.split_evenly(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", 7, "node"))


@query(f"""with {INDEXED} select {n("(t_idx - 4) // 5", "obs")}, {n("south_north - 1", "i")}, {n("west_east", "j")}, {n("(t_idx - 4) % 5", "t")}, {r("u_100m", "u_100m")} from ix where south_north between 1 and 2 and west_east between 0 and 2 and t_idx between 4 and 18""")
def cut_samples(spark, sf_dir):
    return finish(sampling.cut_samples(_indexed(spark, sf_dir), 1, 0, 4, (2, 3, 5), 3), "obs", "i", "j", "t", "u_100m")


@query(f"""with m as (select l_linenumber b, avg(l_tax) w from lineitem group by 1) select {n("b", "bin")}, {r("w / sum(w) over ()", "weight")} from m""")
def loss_weights(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_linenumber": "bin", "l_tax": "loss"})
    return finish(sampling.loss_weights(df, "bin"))
