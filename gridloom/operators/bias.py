"""Statistical bias correction: factors from two histories, and their application.

A series is (gid, time, feature). Factors are computed for all sites in one aggregation;
windows of the year are a join with a table of days, at most 366 rows a window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip
from ..functions.times import in_window, nearest_window, window_centers
from ..store import cut

QUANTILES, WINDOWS, WINDOW_DAYS = 101, 24, 120


def _moments(df: DataFrame, feature: str, by: tuple[str, ...], prefix: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(feature).alias(f"{prefix}_mean"), F.stddev_pop(feature).alias(f"{prefix}_std"))


def _factors(both: DataFrame, scalar_only: bool) -> DataFrame:
    if scalar_only:
        return both.withColumn("scalar", F.try_divide(F.col("base_mean"), F.col("bias_mean"))).withColumn("adder", F.when(F.col("scalar").isNotNull(), 0.0))
    scalar = F.when(F.col("bias_std") == 0, F.col("base_std")).otherwise(F.try_divide(F.col("base_std"), F.col("bias_std")))
    return both.withColumn("scalar", scalar).withColumn("adder", F.col("base_mean") - F.col("bias_mean") * F.col("scalar"))


def linear_factors(base: DataFrame, bias: DataFrame, feature: str, scalar_only: bool = False) -> DataFrame:
    """(gid, t_idx = 0, scalar, adder, means, stds): matches mean and spread, or the mean alone."""
    both = _moments(base, feature, ("gid",), "base").join(_moments(bias, feature, ("gid",), "bias"), "gid")
    return _factors(both.withColumn("t_idx", F.lit(0)), scalar_only)


def monthly_factors(base: DataFrame, bias: DataFrame, feature: str, scalar_only: bool = False) -> DataFrame:
    """The same by month, t_idx 0 to 11; null where a month is missing on either side."""
    month = lambda df: df.withColumn("t_idx", F.month("time") - 1)
    sites = base.select("gid").distinct().join(bias.select("gid").distinct(), "gid")
    slots = sites.select("gid", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("t_idx"))
    by = ["gid", "t_idx"]
    both = slots.join(_moments(month(base), feature, by, "base"), by, "left").join(_moments(month(bias), feature, by, "bias"), by, "left")
    return _factors(both, scalar_only)


def smooth_factors(factors: DataFrame, sigma: float, columns: tuple[str, ...] = ("scalar", "adder")) -> DataFrame:
    """Factors (gid, south_north, west_east, t_idx, columns) smoothed over the grid slot by slot, edges repeated; a null one raises."""
    from .windows import smooth

    top = factors.agg(F.max("south_north").alias("i"), F.max("west_east").alias("j"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    gaps = {c: top[c] for c in columns if top[c]}
    if gaps:
        raise ValueError(f"factors have gaps, fill them before they are smoothed: {gaps}")
    keys = ["south_north", "west_east", "t_idx"]
    for c in columns:
        blurred = smooth(factors.select(*keys, c), c, sigma, (top["i"] or 0) + 1, (top["j"] or 0) + 1, ("t_idx",))
        factors = factors.drop(c).join(blurred, keys)
    return factors


def apply_linear(
    df: DataFrame, factors: DataFrame, feature: str, out_range: tuple[float | None, float | None] = (None, None), scalar_range=(None, None), adder_range=(None, None), smoothing: float = 0.0
) -> DataFrame:
    """x * scalar + adder by site; factors of twelve slots go by the month. Sites without factors stay null.

    Factors are smoothed over the grid first (``smoothing``: the kernel's width in cells), then held to their ranges.
    A site's only slot is repeated for all months, so the join is on site and month alone.
    """
    if smoothing:
        factors = smooth_factors(factors, smoothing)
    factors = factors.withColumns({"scalar": clip(F.col("scalar"), *scalar_range), "adder": clip(F.col("adder"), *adder_range)})
    slots = factors.join(factors.groupBy("gid").agg(F.count("*").alias("_n")), "gid")
    month = F.explode(F.when(F.col("_n") == 1, F.sequence(F.lit(0), F.lit(11))).otherwise(F.array(F.col("t_idx").cast("int"))))
    keyed = df.withColumn("_month", F.month("time") - 1).join(slots.select("gid", "scalar", "adder", month.alias("_month")), ["gid", "_month"], "left")
    return keyed.withColumn(feature, clip(F.col(feature) * F.col("scalar") + F.col("adder"), *out_range)).select(*df.columns)


def apply_linear_averaged(df: DataFrame, factors: DataFrame, feature: str, out_range=(None, None), scalar_range=(None, None), adder_range=(None, None), smoothing: float = 0.0) -> DataFrame:
    """Monthly factors averaged over the months of the data's own times, then applied to all of them; smoothed first if asked."""
    if smoothing:
        factors = smooth_factors(factors, smoothing)
    times = df.select("time").distinct().select((F.month("time") - 1).alias("t_idx"))
    mean = factors.join(times, "t_idx").groupBy("gid").agg(F.avg("scalar").alias("scalar"), F.avg("adder").alias("adder"))
    joined = df.join(mean, "gid", "left")
    value = F.col(feature) * clip(F.col("scalar"), *scalar_range) + clip(F.col("adder"), *adder_range)
    return joined.withColumn(feature, clip(value, *out_range)).drop("scalar", "adder")


def global_linear(df: DataFrame, feature: str, scalar: float, adder: float, out_range=(None, None)) -> DataFrame:
    return df.withColumn(feature, clip(F.col(feature) * scalar + adder, *out_range))


def zero_rate(x: Column, threshold: float = 0.0) -> Column:
    """Share of finite values at or below the threshold (an aggregate)."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.avg(F.when(finite, (x <= threshold).cast("double")))


def _by_site(df: DataFrame, feature: str) -> DataFrame:
    """(gid, feature) dealt out by site once: groups by site and value that follow need no exchange of their own."""
    return df.select("gid", feature).repartition("gid")


def _side_by_side(series: dict[str, DataFrame], feature: str) -> DataFrame:
    """(gid, doy, each of ``series``): the rows of all series, values in the column of their own, dealt out by site once.

    Groups by site and day, value or window that follow need no exchange, and no join puts the series together.
    """
    sides = [df.select("gid", F.dayofyear("time").alias("doy"), *[(F.col(feature) if c == name else F.lit(None)).alias(c) for c in series]) for name, df in series.items()]
    return reduce(DataFrame.unionByName, sides).repartition("gid")


def _at_ranks(df: DataFrame, feature: str, sites: DataFrame, ranks: dict[str, Column]) -> DataFrame:
    """(gid, each of ``ranks``): the value at a rank from 0 on of a site's sorted series; ranks may use ``_size`` and columns of ``sites``.

    Equal values are counted before anything is sorted, and counts run up in a window that holds no site's rows at once.
    """
    counted = df.where(F.col(feature).isNotNull()).groupBy("gid", F.col(feature).alias("_x")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("gid").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counted.withColumn("_upto", upto).join(df.groupBy("gid").agg(F.count(feature).alias("_size")).join(sites, "gid"), "gid")
    return placed.groupBy("gid").agg(*[F.min(F.when(F.col("_upto") > k, F.col("_x"))).alias(name) for name, k in ranks.items()])


def match_zero_rate(base: DataFrame, bias: DataFrame, feature: str) -> DataFrame:
    """``bias`` with values below its quantile at the base's zero rate set to 0."""
    rates = base.groupBy("gid").agg(zero_rate(F.col(feature)).alias("_q"))
    at = F.col("_q") * (F.col("_size") - 1)
    low = _at_ranks(bias, feature, rates, {"_low": F.floor(at), "_high": F.least(F.floor(at) + 1, F.col("_size") - 1)})
    share = bias.where(F.col(feature).isNotNull()).groupBy("gid").agg(F.count("*").alias("_size")).join(rates, "gid").select("gid", (at - F.floor(at)).alias("_share"))
    cuts = low.join(share, "gid").select("gid", (F.col("_low") + F.col("_share") * (F.col("_high") - F.col("_low"))).alias("_cut"))
    return bias.join(cuts, "gid", "left").withColumn(feature, F.when(F.col(feature) < F.col("_cut"), 0.0).otherwise(F.col(feature))).drop("_cut")


def quantile_levels(n: int = QUANTILES, sampling: str = "linear", log_base: float = 10.0) -> list[float]:
    """Levels from 0 to 1: even, or denser towards 0 (log) or 1 (invlog)."""
    even = [i / (n - 1) for i in range(n)]
    if sampling == "linear":
        return even
    low = [(log_base**q - 1) / (log_base - 1) for q in even]
    return low if sampling == "log" else [1 - q for q in reversed(low)]


def window_days(spark: SparkSession, n: int = WINDOWS, days: float = WINDOW_DAYS) -> DataFrame:
    """(t_window, center, doy): which days belong to which window."""
    centers = spark.createDataFrame(list(enumerate(window_centers(n))), "t_window int, center double")
    doys = spark.range(1, 367).select(F.col("id").cast("int").alias("doy"))
    return centers.crossJoin(doys).where(in_window(F.col("doy"), F.col("center"), days))


def _quantiles(series: dict[str, DataFrame], feature: str, n: int, days: float, levels: list[float] | None) -> DataFrame:
    table = window_days(next(iter(series.values())).sparkSession, n, days).select("t_window", "doy")
    rows = _side_by_side(series, feature).withColumn("_x", F.coalesce(*series)).where("_x is not null")
    counted = rows.groupBy("gid", "doy", "_x").agg(*[F.count(c).alias(c) for c in series])
    per_window = counted.join(F.broadcast(table), "doy").groupBy("gid", "t_window")
    return per_window.agg(*[F.percentile("_x", levels or quantile_levels(), F.col(c)).alias(c) for c in series]).dropna(subset=list(series))


def window_quantiles(df: DataFrame, feature: str, name: str, n: int = WINDOWS, days: float = WINDOW_DAYS, levels: list[float] | None = None) -> DataFrame:
    """(gid, t_window, name): quantiles of each site's values in each window; a row counts in every window it is in.

    Equal values of a day are counted first; only the counts are repeated for the windows. Rows are dealt out by
    site before that, so a window's values meet in one task and are not shuffled once a window.
    """
    return _quantiles({name: df}, feature, n, days, levels)


def _means(series: dict[str, DataFrame], feature: str, n: int, days: float) -> DataFrame:
    table = window_days(next(iter(series.values())).sparkSession, n, days).select("t_window", "doy")
    parts = {f"_s_{c}": F.sum(c) for c in series} | {f"_n_{c}": F.count(c) for c in series}
    daily = _side_by_side(series, feature).groupBy("gid", "doy").agg(*[part.alias(name) for name, part in parts.items()])
    return daily.join(F.broadcast(table), "doy").groupBy("gid", "t_window").agg(*[(F.sum(f"_s_{c}") / F.sum(f"_n_{c}")).alias(c) for c in series])


def window_means(df: DataFrame, feature: str, name: str, n: int = WINDOWS, days: float = WINDOW_DAYS) -> DataFrame:
    """(gid, t_window, name): means over each window, from at most 366 sums a site."""
    return _means({name: df}, feature, n, days)


def qdm_params(base: DataFrame, bias: DataFrame, future: DataFrame, feature: str, n: int = WINDOWS, days: float = WINDOW_DAYS, levels: list[float] | None = None) -> DataFrame:
    """(gid, t_window, base, bias, bias_fut): quantiles of the observed, modelled and future series."""
    return _quantiles({"base": base, "bias": bias, "bias_fut": future}, feature, n, days, levels)


def _let(x: Column, f) -> Column:
    """f of x, with x computed once however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _between(x: Column, xs: Column, ys: Column) -> Column:
    """Linear interpolation in arrays, held at the ends."""

    def at(x: Column, k: Column) -> Column:
        x0, x1, y0, y1 = F.get(xs, k - 1), F.get(xs, k), F.get(ys, k - 1), F.get(ys, k)
        share = F.coalesce(F.try_divide(x - x0, x1 - x0), F.lit(0.0))
        return y0 + F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * (y1 - y0)

    place = lambda x: F.greatest(F.lit(1), F.least(F.size(xs) - 1, F.size(F.filter(xs, lambda v: v <= x))))
    return F.when(x.isNotNull(), _let(x, lambda x: _let(place(x), lambda k: at(x, k))))


def quantile_delta(x: Column, base: Column, bias: Column, future: Column, levels: Column, relative: bool = True, denominator_least: float | None = None, delta_range=(None, None)) -> Column:
    """Cannon's quantile delta mapping: the change of the model at x's quantile, put on the observed distribution."""

    def changed(historic: Column, observed: Column) -> Column:
        if not relative:
            return observed + clip(x - historic, *delta_range)
        floor = F.when(historic == 0, F.lit(denominator_least or 0.001)).otherwise(historic)
        if denominator_least is not None:
            floor = F.greatest(floor, F.lit(denominator_least))
        return observed * clip(x / floor, *delta_range)

    both = lambda tau: F.struct(_between(tau, levels, bias).alias("historic"), _between(tau, levels, base).alias("observed"))
    return _let(_let(_between(x, future, levels), both), lambda s: changed(s["historic"], s["observed"]))


def _mapped(keyed: DataFrame, params: DataFrame, feature: str, levels: list[float] | None, relative: bool, no_trend: bool, more: dict) -> DataFrame:
    """Quantile delta mapping of rows that have a ``t_window``."""
    joined = keyed.join(params.select("gid", "t_window", "base", "bias", "bias_fut"), ["gid", "t_window"], "left")
    grid = F.array(*[F.lit(q) for q in levels or quantile_levels()])
    value = quantile_delta(F.col(feature), F.col("base"), F.col("bias"), F.col("bias") if no_trend else F.col("bias_fut"), grid, relative, **more)
    return joined.withColumn(feature, value).drop("base", "bias", "bias_fut")


def apply_qdm(df: DataFrame, params: DataFrame, feature: str, n: int = WINDOWS, levels: list[float] | None = None, relative: bool = True, no_trend: bool = False, out_range=(None, None), **more) -> DataFrame:
    """Each row by the parameters of its site and the window nearest to its day of the year; a value that is not finite then raises, nulls stay."""
    done = _mapped(df.withColumn("t_window", nearest_window(F.dayofyear("time"), n)), params, feature, levels, relative, no_trend, more)
    bad = F.isnan(feature) | (F.abs(feature) == F.lit(float("inf")))
    told = F.concat(F.lit(f"{feature} is not finite after quantile mapping at site "), F.col("gid").cast("string"))
    finite = F.when(bad, F.raise_error(told).cast("double")).otherwise(F.col(feature))
    return done.withColumn(feature, clip(finite, *out_range)).drop("t_window")


def presrat_params(base: DataFrame, bias: DataFrame, future: DataFrame, feature: str, threshold: float = 1.157e-7, n: int = WINDOWS, days: float = WINDOW_DAYS, levels: list[float] | None = None) -> DataFrame:
    """qdm_params with zero_rate, tau_fut (by site) and k_factor (by site and window).

    tau is the modelled value at the observed share of dry times; the share of future values
    below it gives the corrected future value below which all is dry. K keeps the modelled change of the
    mean. The corrected future is mapped with the last window that a day is in, and enters K as it is.
    """
    params = cut(qdm_params(base, bias, future, feature, n, days, levels))
    table = window_days(base.sparkSession, n, days)
    last = F.broadcast(table.groupBy("doy").agg(F.max("t_window").alias("t_window")))
    dated = future.withColumn("doy", F.dayofyear("time")).join(last, "doy").drop("doy")
    corrected = cut(_mapped(dated, params, feature, levels, True, False, {"denominator_least": threshold}).drop("t_window"))
    dry = base.groupBy("gid").agg(zero_rate(F.col(feature), threshold).alias("zero_rate"))
    rank = lambda share: F.least(F.bround(F.col(share) * F.col("_size")).cast("long"), F.col("_size") - 1)
    tau = _at_ranks(_by_site(bias, feature), feature, dry, {"_tau": rank("zero_rate")})
    below = _by_site(future, feature).where(F.col(feature).isNotNull()).join(tau, "gid").groupBy("gid").agg(F.avg((F.col(feature) < F.col("_tau")).cast("double")).alias("_share"))
    site = dry.join(_at_ranks(_by_site(corrected, feature), feature, below, {"tau_fut": rank("_share")}), "gid")
    # windows that a history lacks are not in ``params``
    mean = lambda name: F.greatest(F.col(name), F.lit(threshold))
    means = _means({"mh": bias, "mf": future, "oh": base, "mu": corrected}, feature, n, days)
    k = means.select("gid", "t_window", ((mean("mf") / mean("mh")) / (mean("mu") / mean("oh"))).alias("k_factor"))
    return params.join(site, "gid").join(k, ["gid", "t_window"])


def apply_presrat(df: DataFrame, params: DataFrame, feature: str, threshold: float = 1.157e-7, n: int = WINDOWS, no_trend: bool = False, k_range=(None, None), out_range=(None, None), levels: list[float] | None = None) -> DataFrame:
    """Quantile delta mapping, then dry below tau_fut and the rest times K (neither without trend)."""
    done = apply_qdm(df, params, feature, n, levels, no_trend=no_trend, denominator_least=threshold)
    if no_trend:
        return done.withColumn(feature, clip(F.col(feature), *out_range))
    keyed = done.withColumn("t_window", nearest_window(F.dayofyear("time"), n)).join(params.select("gid", "t_window", "k_factor", "tau_fut"), ["gid", "t_window"], "left")
    value = F.when(F.col(feature) < F.col("tau_fut"), 0.0).otherwise(F.col(feature) * clip(F.col("k_factor"), *k_range))
    return keyed.withColumn(feature, clip(value, *out_range)).drop("t_window", "k_factor", "tau_fut")


def skill_assessment(base: DataFrame, bias: DataFrame, feature: str) -> DataFrame:
    """Bias of the mean, both sides' moments, and the distance of the centred distributions, by site."""
    from .stats import ks_distance, ks_p_value, skill

    side = lambda df, p: skill(df, feature, ("gid",)).join(df.groupBy("gid").agg(F.count(feature).alias("n")), "gid").withColumnsRenamed({c: f"{p}_{c}" for c in ("mean", "std", "skew", "kurtosis", "zero_rate", "percentiles", "n")})
    mean = lambda df: df.groupBy("gid").agg(F.avg(feature).alias("_mean"))
    centred = lambda df: df.join(mean(df), "gid").withColumn(feature, F.col(feature) - F.col("_mean")).drop("_mean")
    both = side(base, "base").join(side(bias, "bias"), "gid").join(ks_distance(centred(base), centred(bias), feature, ("gid",)), "gid")
    return both.withColumn("bias", F.col("bias_mean") - F.col("base_mean")).withColumn("ks_p", ks_p_value(F.col("ks"), F.col("base_n"), F.col("bias_n")))


def monthly_moments(base: DataFrame, bias: DataFrame, feature: str) -> DataFrame:
    """(gid, month, means and standard deviations of both sides); null where a side lacks the month."""
    side = lambda df, p: _moments(df.withColumn("month", F.month("time")), feature, ("gid", "month"), p)
    return side(base, "base").join(side(bias, "bias"), ["gid", "month"], "full")


def pair_histories(base: DataFrame, bias_meta: DataFrame, feature: str, bound: float, method: str | None = None) -> DataFrame:
    """The base series of each modelled site: mean over the base sites nearest to it, by day with a method."""
    from .coarsen import reduce_daily
    from .neighbors import nn_join

    mapping = nn_join(base.select("gid", "latitude", "longitude").distinct(), bias_meta, bound).where("tid is not null")
    mean = base.join(mapping, F.col("gid") == F.col("sid")).groupBy(F.col("tid").alias("gid"), "time").agg(F.avg(feature).alias(feature))
    return reduce_daily(mean, feature, method) if method else mean


def sites_without_base(bias_meta: DataFrame, base: DataFrame) -> DataFrame:
    return bias_meta.join(base.select("gid").distinct(), "gid", "left_anti")


def fill_and_smooth(factors: DataFrame, columns: list[str], rows: int, columns_n: int, fill: bool = True, smooth_extend: float = 0.0, smooth_interior: float = 0.0) -> DataFrame:
    """Factor rasters (south_north, west_east, t_idx, columns): gaps from the nearest cell, then smoothed outside and inside apart."""
    from .windows import fill_nearest, smooth

    for c in columns:
        one = factors.select("south_north", "west_east", "t_idx", c, F.col(c).isNull().alias("_out"))
        done = fill_nearest(one, c, ("t_idx",)) if fill else one
        for sigma, outside in ((smooth_extend, True), (smooth_interior, False)):
            if sigma:
                blurred = smooth(done.select("south_north", "west_east", "t_idx", c), c, sigma, rows, columns_n, ("t_idx",)).withColumnRenamed(c, "_b")
                done = done.join(blurred, ["south_north", "west_east", "t_idx"], "left").withColumn(c, F.when(F.col("_out") == F.lit(outside), F.col("_b")).otherwise(F.col(c))).drop("_b")
        factors = factors.drop(c).join(done.drop("_out"), ["south_north", "west_east", "t_idx"])
    return factors


def scale_monthly(df: DataFrame, monthly: DataFrame, feature: str, global_scalar: float = 1.0) -> DataFrame:
    """A data set times its site's monthly scalar and one for all: (gid, month, scalar)."""
    joined = df.withColumn("month", F.month("time")).join(monthly, ["gid", "month"], "left")
    return joined.withColumn(feature, F.col(feature) * F.col("scalar") * global_scalar).drop("month", "scalar")


#: Corrections by name, for configurations: each takes (df, factors, feature) and options.
METHODS = {"linear": apply_linear, "linear_averaged": apply_linear_averaged, "qdm": apply_qdm, "presrat": apply_presrat}


def correct(df: DataFrame, method: str, factors: DataFrame, features: list[str], **options) -> DataFrame:
    for f in features:
        df = METHODS[method](df, factors, f, **options)
    return df
