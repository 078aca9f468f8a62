"""Queries: bias factors and corrections of site series."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from .cubes import HISTORY_SQL, SITES_SQL, histories, in_debt, of_nations, sites
from .finish import finish, n, r, t
from .functions import times as T
from .operators import bias, coarsen, stats
from .queries import SQL, query

MEANS = "b as (select gid, avg(x) bm, stddev_pop(x) bs from base group by gid), m as (select gid, avg(x) mm, stddev_pop(x) ms from bias group by gid), f as (select gid, case when ms = 0 then bs else bs / ms end scalar, bm, mm from b join m using (gid))"
MONTHS = """mo as (select month(time) - 1 t_idx, * exclude (time) from base), mi as (select month(time) - 1 t_idx, * exclude (time) from bias),
b as (select gid, t_idx, avg(x) bm, stddev_pop(x) bs from mo group by gid, t_idx), m as (select gid, t_idx, avg(x) mm, stddev_pop(x) ms from mi group by gid, t_idx),
s as (select g.gid, k.t_idx from (select distinct gid from base join bias using (gid)) g, unnest(range(0, 12)) k(t_idx)),
f as (select gid, t_idx, case when ms = 0 then bs else bs / ms end scalar, bm, mm from s left join b using (gid, t_idx) left join m using (gid, t_idx))"""


@query(f"with {HISTORY_SQL}, {MEANS} select {n('gid')}, 0::bigint t_idx, {r('scalar', 'scalar')}, {r('bm - mm * scalar', 'adder')} from f")
def linear_factors(spark, sf_dir):
    base, modelled, _ = histories(spark, sf_dir)
    return finish(bias.linear_factors(base, modelled, "x"), "gid", "t_idx", "scalar", "adder")


@query(f"with {HISTORY_SQL}, {MEANS} select {n('gid')}, {r('bm / mm', 'scalar')}, {r('0', 'adder')} from f")
def scalar_factors(spark, sf_dir):
    base, modelled, _ = histories(spark, sf_dir)
    return finish(bias.linear_factors(base, modelled, "x", scalar_only=True), "gid", "scalar", "adder")


@query(f"with {HISTORY_SQL}, {MONTHS} select {n('gid')}, {n('t_idx')}, {r('scalar', 'scalar')}, {r('bm - mm * scalar', 'adder')} from f")
def monthly_factors(spark, sf_dir):
    base, modelled, _ = histories(spark, sf_dir)
    return finish(bias.monthly_factors(base, modelled, "x"), "gid", "t_idx", "scalar", "adder")


ROWS = f"select {n('gid')}, {t('time')}, {r('y', 'x')} from y"


def _rows(df):
    return finish(df, "gid", "time", "x")


@query(f"with {HISTORY_SQL}, {MEANS}, y as (select fut.gid, time, least(greatest(x * scalar + bm - mm * scalar, 1), 45) y from fut left join f using (gid)) {ROWS}")
def corrected_linear(spark, sf_dir):
    base, modelled, future = histories(spark, sf_dir)
    return _rows(bias.correct(future, "linear", bias.linear_factors(base, modelled, "x"), ["x"], out_range=(1, 45)))


@query(f"with {HISTORY_SQL}, {MONTHS}, y as (select fut.gid, time, x * scalar + bm - mm * scalar y from fut left join f on f.gid = fut.gid and f.t_idx = month(time) - 1) {ROWS}")
def corrected_monthly(spark, sf_dir):
    base, modelled, future = histories(spark, sf_dir)
    return _rows(bias.apply_linear(future, bias.monthly_factors(base, modelled, "x"), "x"))


@query(f"""with {HISTORY_SQL}, {MONTHS}, a as (select gid, avg(scalar) sc, avg(bm - mm * scalar) ad from f join (select distinct time from fut) ft on t_idx = month(time) - 1 group by gid),
y as (select fut.gid, time, x * least(greatest(sc, 0.5), 1.5) + ad y from fut left join a using (gid)) {ROWS}""")
def corrected_averaged(spark, sf_dir):
    base, modelled, future = histories(spark, sf_dir)
    return _rows(bias.apply_linear_averaged(future, bias.monthly_factors(base, modelled, "x"), "x", scalar_range=(0.5, 1.5)))


@query(f"with {HISTORY_SQL}, y as (select gid, time, least(x * 1.5 - 3, 60) y from fut) {ROWS}")
def corrected_global(spark, sf_dir):
    return _rows(bias.global_linear(histories(spark, sf_dir)[2], "x", 1.5, -3.0, (None, 60)))


@query(f"""with {HISTORY_SQL}, ms as (select gid, month(time) as month, 1 + 0.01 * month(time) scalar from fut group by 1, 2), y as (select fut.gid, time, x * scalar * 0.5 y from fut join ms on ms.gid = fut.gid and ms.month = month(time)) {ROWS}""")
def scaled_monthly(spark, sf_dir):
    future = histories(spark, sf_dir)[2]
    monthly = future.select("gid", F.month("time").alias("month")).distinct().withColumn("scalar", 1 + 0.01 * F.col("month"))
    return _rows(bias.scale_monthly(future, monthly, "x", 0.5))


def _central(k: int) -> str:
    return f"avg((x - mu) ** {k})"


@query(f"""with {HISTORY_SQL}, c as (select *, avg(x) over (partition by gid) mu from base)
select {n("gid")}, {r("avg(x)", "mean")}, {r("stddev_pop(x)", "std")}, {r(f"{_central(3)} / {_central(2)} ** 1.5", "skew")}, {r(f"{_central(4)} / {_central(2)} ** 2 - 3", "kurtosis")}, {r("avg((x = 0)::int)", "zero_rate")},
{r("quantile_cont(x, 0.05)", "p05")}, {r("quantile_cont(x, 0.5)", "p50")}, {r("quantile_cont(x, 0.99)", "p99")} from c group by gid""")
def skill(spark, sf_dir):
    p = F.col("percentiles")
    done = stats.skill(histories(spark, sf_dir)[0], "x", ("gid",)).withColumns({"p05": p[1], "p50": p[3], "p99": p[6]}).drop("percentiles")
    return finish(done)


KS = """k as (select gid, x, 1 a, 0 b from base union all select gid, x, 0, 1 from bias), s as (select gid, x, sum(a) a, sum(b) b from k group by gid, x),
w as (select gid, abs(sum(a) over c / nullif(sum(a) over g, 0)::double - sum(b) over c / nullif(sum(b) over g, 0)::double) d from s window c as (partition by gid order by x), g as (partition by gid))"""


@query(f"with {HISTORY_SQL}, {KS} select {n('gid')}, {r('max(d)', 'ks')} from w group by gid")
def ks_distance(spark, sf_dir):
    base, modelled, _ = histories(spark, sf_dir)
    return finish(stats.ks_distance(base, modelled, "x", ("gid",)))


@query(f"""with {HISTORY_SQL}, q as (select gid, avg((x <= 5)::int) z from base group by gid) select {n("gid")}, {r("z", "zero_rate")} from q""")
def zero_rate(spark, sf_dir):
    return finish(histories(spark, sf_dir)[0].groupBy("gid").agg(bias.zero_rate(F.col("x"), 5.0).alias("zero_rate")))


@query(f"""with {HISTORY_SQL}, b0 as (select gid, avg((case when x < 8 then 0 else x end <= 0)::int) z from base group by gid), s as (select gid, list(x order by x) l from bias group by gid),
c as (select s.gid, z * (len(l) - 1) a, l from s join b0 using (gid)), d as (select gid, l[floor(a)::int + 1] + (a - floor(a)) * (coalesce(l[floor(a)::int + 2], l[floor(a)::int + 1]) - l[floor(a)::int + 1]) cut from c),
y as (select bias.gid, time, case when x < cut then 0 else x end y from bias left join d using (gid)) {ROWS}""")
def matched_zero_rate(spark, sf_dir):
    base, modelled, _ = histories(spark, sf_dir)
    dry = base.withColumn("x", F.when(F.col("x") < 8, 0.0).otherwise(F.col("x")))
    return _rows(bias.match_zero_rate(dry, modelled, "x"))


CENTERS = ", ".join(f"({i}, {c!r}::double)" for i, c in enumerate(T.window_centers(12)))
LEVELS = "[" + ", ".join(repr(q) for q in bias.quantile_levels(11)) + "]"
INSIDE = "case when c - 30 < 0 then doy > 365 + c - 30 or doy < c + 30 when c + 30 > 365 then doy > c - 30 or doy < c + 30 - 365 else doy > c - 30 and doy < c + 30 end"
QUANTILES = f"""wn as (select * from (values {CENTERS}) v(t_window, c)), """ + ", ".join(
    f"q_{name} as (select gid, t_window, quantile_cont(x, {LEVELS}) {name}_q from (select gid, x, dayofyear(time) doy from {name}) z join wn on {INSIDE} group by gid, t_window)" for name in ("base", "bias", "fut")
)


@query(f"""with {HISTORY_SQL}, {QUANTILES} select {n("gid")}, {n("t_window")}, {n("k", "level")}, {r("base_q[k + 1]", "base")}, {r("bias_q[k + 1]", "bias")}, {r("fut_q[k + 1]", "bias_fut")}
from q_base join q_bias using (gid, t_window) join q_fut using (gid, t_window), unnest(range(0, 11)) u(k)""")
def qdm_params(spark, sf_dir):
    params = bias.qdm_params(*histories(spark, sf_dir), "x", 12, 60, bias.quantile_levels(11))
    return finish(params.select("gid", "t_window", F.posexplode(F.arrays_zip("base", "bias", "bias_fut")).alias("level", "q")).select("gid", "t_window", "level", "q.*"))


def _interpolated(x: str, xs: str, ys: str) -> str:
    k = f"greatest(1, least(len({xs}) - 1, len(list_filter({xs}, lambda v: v <= {x}))))"
    share = f"coalesce(({x} - {xs}[{k}]) / nullif({xs}[{k} + 1] - {xs}[{k}], 0), 0)"
    return f"({ys}[{k}] + greatest(0, least(1, {share})) * ({ys}[{k} + 1] - {ys}[{k}]))"


NEAREST = "(select arg_min(t_window, struct_pack(d := abs(dayofyear(time) - c), i := t_window)) from wn)"
LAST = f"(select max(t_window) from wn where {INSIDE.replace('doy', 'dayofyear(time)')})"


def _mapped(name: str, window: str, denominator: str) -> str:
    """CTEs that end in ``name``: (gid, time, t_window, x) of the future, quantile mapped with the given window's parameters."""
    return f"""{name}_x as (select gid, time, x, {window} t_window from fut),
{name}_j as (select v.*, base_q, bias_q, fut_q from {name}_x v left join q_base using (gid, t_window) left join q_bias using (gid, t_window) left join q_fut using (gid, t_window)),
{name}_a as (select gid, time, t_window, x, base_q, bias_q, {_interpolated("x", "fut_q", LEVELS)} tau from {name}_j), {name}_h as (select gid, time, t_window, x, {_interpolated("tau", LEVELS, "bias_q")} mh, {_interpolated("tau", LEVELS, "base_q")} oh from {name}_a),
{name} as (select gid, time, t_window, oh * (x / {denominator}) x from {name}_h)"""


@query(f"""with {HISTORY_SQL}, {QUANTILES}, {_mapped("m", NEAREST, "case when mh = 0 then 0.001 else mh end")}, y as (select gid, time, x y from m) {ROWS}""")
def corrected_qdm(spark, sf_dir):
    base, modelled, future = histories(spark, sf_dir)
    levels = bias.quantile_levels(11)
    params = bias.qdm_params(base, modelled, future, "x", 12, 60, levels)
    return _rows(bias.apply_qdm(future, params, "x", 12, levels))


def _window_mean(source: str, name: str) -> str:
    return f"{name} as (select gid, t_window, greatest(avg(x), 1.0) {name} from (select gid, x, dayofyear(time) doy from {source}) z join wn on {INSIDE} group by gid, t_window)"


def _at_rank(source: str, share: str) -> str:
    return f"l[least(round_even({share} * len(l), 0)::bigint, len(l) - 1) + 1]", f"(select gid, list(x order by x) l from {source} group by gid)"


PRESRAT = f"""{QUANTILES}, {_mapped("last", LAST, "greatest(case when mh = 0 then 1.0 else mh end, 1.0)")}, {_mapped("near", NEAREST, "greatest(case when mh = 0 then 1.0 else mh end, 1.0)")},
dry as (select gid, avg((x <= 1.0)::int) z from base group by gid), ta as (select gid, {_at_rank("bias", "z")[0]} tau from {_at_rank("bias", "z")[1]} join dry using (gid)),
sh as (select gid, avg((x < tau)::int) share from fut join ta using (gid) group by gid), tf as (select gid, {_at_rank("last", "share")[0]} tau_fut from {_at_rank("last", "share")[1]} join sh using (gid)),
{_window_mean("bias", "mh")}, {_window_mean("fut", "mf")}, {_window_mean("base", "oh")}, {_window_mean("last", "mu")},
k as (select gid, t_window, (mf / mh) / (mu / oh) k_factor from mh join mf using (gid, t_window) join oh using (gid, t_window) join mu using (gid, t_window))"""


@query(f"""with {HISTORY_SQL}, {PRESRAT}, y as (select near.gid, time, case when x < tau_fut then 0 else x * k_factor end y from near left join k using (gid, t_window) left join tf on tf.gid = near.gid) {ROWS}""")
def corrected_presrat(spark, sf_dir):
    base, modelled, future = histories(spark, sf_dir)
    levels = bias.quantile_levels(11)
    params = bias.presrat_params(base, modelled, future, "x", 1.0, 12, 60, levels)
    return _rows(bias.apply_presrat(future, params, "x", 1.0, 12, levels=levels))


@query(f"""with {HISTORY_SQL}, {PRESRAT} select {n("gid")}, {n("t_window")}, {r("z", "zero_rate")}, {r("tau_fut", "tau_fut")}, {r("k_factor", "k_factor")} from k join dry using (gid) join tf using (gid)""")
def presrat_params(spark, sf_dir):
    base, modelled, future = histories(spark, sf_dir)
    return finish(bias.presrat_params(base, modelled, future, "x", 1.0, 12, 60, bias.quantile_levels(11)), "gid", "t_window", "zero_rate", "tau_fut", "k_factor")


@query(f"""with {HISTORY_SQL}, {SITES_SQL}, d as (select gid, date_trunc('day', time) date, max(x) x from base group by 1, 2) select {n("gid")}, {t("date", "date")}, {r("x", "x")} from d""")
def reduced_daily(spark, sf_dir):
    return finish(coarsen.reduce_daily(histories(spark, sf_dir)[0], "x", "max"))


@query(f"""with {HISTORY_SQL}, {SITES_SQL}, s as (select gid, latitude, longitude from sites), t2 as (select gid, latitude + 0.02 latitude, longitude + 0.031 longitude from sites),
pr as (select s.gid sid, t2.gid tid, sqrt((s.latitude - t2.latitude) ** 2 + (s.longitude - t2.longitude) ** 2) d from s, t2), b as (select sid, arg_min(tid, struct_pack(d := d, t := tid)) tid from pr where d < 0.15 group by sid),
m as (select tid gid, time, avg(x) x from base join b on base.gid = sid group by tid, time), d as (select gid, date_trunc('day', time) date, avg(x) x from m group by 1, 2)
select {n("gid")}, {t("date", "date")}, {r("x", "x")} from d""")
def paired_histories(spark, sf_dir):
    return _paired_histories(spark, sf_dir)


@query(SQL["paired_histories"])
def paired_histories_all(spark, sf_dir):
    """Of every site."""
    return _paired_histories(spark, sf_dir)


def _paired_histories(spark, sf_dir):
    s = sites(spark, sf_dir, exact=True)
    base = histories(spark, sf_dir)[0].join(s.select("gid", "latitude", "longitude"), "gid")
    meta = s.select("gid", (F.col("latitude") + Decimal("0.02")).alias("latitude"), (F.col("longitude") + Decimal("0.031")).alias("longitude"))
    return finish(bias.pair_histories(base, meta, "x", 0.15, "avg"))


@query(f"with {HISTORY_SQL}, {SITES_SQL} select {n('gid')} from sites where gid not in (select gid from base where gid not in (select s_suppkey from supplier where s_nationkey < 12))")
def sites_without_base(spark, sf_dir):
    return finish(bias.sites_without_base(sites(spark, sf_dir), histories(spark, sf_dir)[0].join(of_nations(spark, sf_dir), "gid", "left_anti")).select("gid"))


@query(f"with {HISTORY_SQL}, {SITES_SQL} select {n('gid')} from sites where gid not in (select gid from base where gid not in (select s_suppkey from supplier where s_acctbal < 0))")
def sites_without_base_in_debt(spark, sf_dir):
    """Without the series of suppliers in debt."""
    base = histories(spark, sf_dir)[0].join(in_debt(spark, sf_dir), "gid", "left_anti")
    return finish(bias.sites_without_base(sites(spark, sf_dir), base).select("gid"))


def _side(source: str) -> str:
    return f"""{source}_s as (select gid, avg(x) mean, stddev_pop(x) std, {_central(3)} / {_central(2)} ** 1.5 skew, {_central(4)} / {_central(2)} ** 2 - 3 kurtosis, avg((x = 0)::int) zero_rate, quantile_cont(x, [0.05, 0.5, 0.99]) q, count(x) n
 from (select *, avg(x) over (partition by gid) mu from {source}) group by gid)"""


def _sides() -> str:
    columns = ("mean", "std", "skew", "kurtosis", "zero_rate")
    return ", ".join([r(f"{s}_s.{c}", f"{s}_{c}") for s in ("base", "bias") for c in columns] + [r(f"{s}_s.q[{k}]", f"{s}_{p}") for s in ("base", "bias") for k, p in ((1, "p05"), (2, "p50"), (3, "p99"))] + [n(f"{s}_s.n", f"{s}_n") for s in ("base", "bias")])


CENTRED = KS.replace("select gid, x, 1 a, 0 b from base", "select gid, x - avg(x) over (partition by gid) x, 1 a, 0 b from base").replace("select gid, x, 0, 1 from bias", "select gid, x - avg(x) over (partition by gid), 0, 1 from bias")
SIZE = "sqrt(base_s.n * bias_s.n / (base_s.n + bias_s.n)::double)"
SERIES = " + ".join(f"{2.0 if k % 2 else -2.0} * exp(-2.0 * {k * k} * z * z)" for k in range(1, 21))


@query(f"""with {HISTORY_SQL}, {_side("base")}, {_side("bias")}, {CENTRED}, d as (select gid, max(d) ks from w group by gid), p as (select gid, ks, ({SIZE} + 0.12 + 0.11 / {SIZE}) * ks z from d join base_s using (gid) join bias_s using (gid))
select {n("p.gid", "gid")}, {_sides()}, {r("ks", "ks")}, {r("bias_s.mean - base_s.mean", "bias")}, {r(f"case when z < 0.2 then 1 else greatest(0, least(1, {SERIES})) end", "ks_p")} from p join base_s using (gid) join bias_s using (gid)""")
def skill_assessment(spark, sf_dir):
    base, modelled, _ = histories(spark, sf_dir)
    p = lambda s: F.col(f"{s}_percentiles")
    done = bias.skill_assessment(base, modelled, "x").withColumns({f"{s}_{name}": p(s)[k] for s in ("base", "bias") for k, name in ((1, "p05"), (3, "p50"), (6, "p99"))})
    return finish(done.drop("base_percentiles", "bias_percentiles"))


@query(f"""with {HISTORY_SQL}, a as (select gid, month(time) mo, avg(x) m, stddev_pop(x) s from base group by 1, 2), b as (select gid, month(time) mo, avg(x) m, stddev_pop(x) s from bias group by 1, 2)
select {n("coalesce(a.gid, b.gid)", "gid")}, {n("coalesce(a.mo, b.mo)", "mon")}, {r("a.m", "base_mean")}, {r("a.s", "base_std")}, {r("b.m", "bias_mean")}, {r("b.s", "bias_std")} from a full join b on a.gid = b.gid and a.mo = b.mo""")
def monthly_moments(spark, sf_dir):
    base, modelled, _ = histories(spark, sf_dir)
    return finish(bias.monthly_moments(base, modelled, "x").withColumnRenamed("month", "mon"), "gid", "mon", "base_mean", "base_std", "bias_mean", "bias_std")


def _levels_query(sampling: str):
    levels = bias.quantile_levels(7, sampling)
    text = "[" + ", ".join(repr(q) for q in levels) + "]"
    sql = f"""with {HISTORY_SQL}, {QUANTILES.replace(LEVELS, text)} select {n("gid")}, {n("t_window")}, {n("k", "level")}, {r("base_q[k + 1]", "base")}, {r("bias_q[k + 1]", "bias")}, {r("fut_q[k + 1]", "bias_fut")}
from q_base join q_bias using (gid, t_window) join q_fut using (gid, t_window), unnest(range(0, 7)) u(k)"""

    def run(spark, sf_dir):
        params = bias.qdm_params(*histories(spark, sf_dir), "x", 12, 60, levels)
        return finish(params.select("gid", "t_window", F.posexplode(F.arrays_zip("base", "bias", "bias_fut")).alias("level", "q")).select("gid", "t_window", "level", "q.*"))

    run.__name__ = f"qdm_params_{sampling}"
    return query(sql)(run)


qdm_params_log, qdm_params_invlog = _levels_query("log"), _levels_query("invlog")


@query(f"""with {HISTORY_SQL}, {SITES_SQL}, {MONTHS}, pl as (select south_north, west_east, t_idx, gid, case when t_idx % 4 = 1 and west_east = 2 then null else scalar end scalar from sites join f using (gid)),
ok as (select * from pl where scalar is not null), pr as (select p.gid, p.t_idx, arg_min(ok.scalar, struct_pack(d := sqrt((p.south_north - ok.south_north) ** 2 + (p.west_east - ok.west_east) ** 2), i := ok.south_north, j := ok.west_east)) x from pl p join ok on p.t_idx = ok.t_idx where p.scalar is null group by p.gid, p.t_idx)
select {n("south_north")}, {n("west_east")}, {n("pl.t_idx", "t_idx")}, {r("coalesce(scalar, x)", "scalar")} from pl left join pr using (gid, t_idx)""")
def filled_factors(spark, sf_dir):
    """Factors as a raster, some taken out, gaps from the nearest cell."""
    base, modelled, _ = histories(spark, sf_dir)
    placed = sites(spark, sf_dir).select("gid", "south_north", "west_east").join(bias.monthly_factors(base, modelled, "x"), "gid")
    gaps = placed.withColumn("scalar", F.when((F.col("t_idx") % 4 == 1) & (F.col("west_east") == 2), None).otherwise(F.col("scalar"))).select("south_north", "west_east", "t_idx", "scalar")
    return finish(bias.fill_and_smooth(gaps, ["scalar"], 1, 5), "south_north", "west_east", "t_idx", "scalar")
