"""Statistics of features, distributions and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _long(df: DataFrame, features: list[str], values: dict[str, callable]) -> DataFrame:
    """One row a feature from one aggregation."""
    one = df.agg(*[F.struct(*[how(F.col(f)).alias(name) for name, how in values.items()]).alias(f) for f in features])
    return one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), *[F.col(f"{f}.{name}").alias(name) for name in values]) for f in features])))


def mean_std(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean, std): population standard deviation, nulls left out."""
    return _long(df, features, {"mean": F.avg, "std": F.stddev_pop})


def qa_table(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, nan_perc, std, mean, min, max)."""
    return _long(df, features, {"nan_perc": lambda x: 100 * F.count_if(x.isNull()) / F.count("*"), "std": F.stddev_pop, "mean": F.avg, "min": F.min, "max": F.max})


def pooled(df: DataFrame, features: list[str], container: str = "container_id") -> DataFrame:
    """(feature, mean, std) over containers weighted by their sizes: the mean of means, and the root of the mean of variances within containers."""
    each = df.groupBy(container).agg(F.count("*").alias("n"), *[F.struct(F.avg(f).alias("m"), F.stddev_pop(f).alias("s")).alias(f) for f in features])
    mean = lambda f: F.sum(F.col("n") * F.col(f"{f}.m")) / F.sum("n")
    std = lambda f: F.sqrt(F.sum(F.col("n") * F.col(f"{f}.s") * F.col(f"{f}.s")) / F.sum("n"))
    one = each.agg(*[F.struct(mean(f).alias("mean"), std(f).alias("std")).alias(f) for f in features])
    return one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}.mean").alias("mean"), F.col(f"{f}.std").alias("std")) for f in features])))


def normalize(df: DataFrame, means: dict[str, float], stds: dict[str, float]) -> DataFrame:
    """(x - mean) / std for features in both; a std of 0 counts as 1."""
    return df.withColumns({f: (F.col(f) - means[f]) / (stds[f] or 1.0) for f in df.columns if f in means and f in stds})


def unnormalize(df: DataFrame, means: dict[str, float], stds: dict[str, float]) -> DataFrame:
    return df.withColumns({f: F.col(f) * (stds[f] or 1.0) + means[f] for f in df.columns if f in means and f in stds})


def multiply(df: DataFrame, features: list[str], k: float) -> DataFrame:
    return df.withColumns({f: F.col(f) * k for f in features})


def power(df: DataFrame, features: list[str], k: float) -> DataFrame:
    return df.withColumns({f: F.pow(F.col(f), F.lit(float(k))) for f in features})


def bucket(x: Column, least: float, most: float, bins: int) -> Column:
    """Index of the bin, the last one closed on the right; null outside."""
    at = F.floor((x - least) / ((most - least) / bins)).cast("int")
    return F.when((x >= least) & (x <= most), F.least(at, F.lit(bins - 1)))


def histogram(df: DataFrame, feature: str, least: float, most: float, bins: int = 40, by: tuple[str, ...] = ()) -> DataFrame:
    """(bin, count, center, density) of the bins that have values."""
    width = (most - least) / bins
    counts = df.withColumn("bin", bucket(F.col(feature), least, most, bins)).where("bin is not null").groupBy(*by, "bin").agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy(*by)) if by else F.sum("count").over(Window.partitionBy(F.lit(0)))
    return counts.withColumns({"center": least + (F.col("bin") + 0.5) * width, "density": F.col("count") / (total * width)})


def filled_histogram(df: DataFrame, feature: str, least: float, most: float, bins: int = 40, by: tuple[str, ...] = ()) -> DataFrame:
    """(bin, count, center, share) of all bins: an empty bin between two that have values gets what the line between their counts says, others 0; shares add up to 1."""
    width = (most - least) / bins
    counts = histogram(df, feature, least, most, bins, by).select(*by, "bin", F.col("count").cast("double").alias("count"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    slots = (counts.select(*by).distinct().crossJoin(F.broadcast(every)) if by else every).join(counts, [*by, "bin"], "left")
    w = Window.partitionBy(*by, *([] if by else [F.lit(0)])).orderBy("bin")  # as many rows as bins
    known = F.when(F.col("count").isNotNull(), F.struct("bin", "count"))
    before, behind = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.first(known, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    line = F.col("_a.count") + (F.col("_b.count") - F.col("_a.count")) * (F.col("bin") - F.col("_a.bin")) / (F.col("_b.bin") - F.col("_a.bin"))
    filled = slots.withColumns({"_a": before, "_b": behind}).withColumn("count", F.coalesce("count", line, F.lit(0.0))).drop("_a", "_b")
    total = F.sum("count").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    return filled.withColumns({"center": least + (F.col("bin") + 0.5) * width, "share": F.try_divide(F.col("count"), total)})


def trimmed_range(df: DataFrame, feature: str, percentile: float = 99.9) -> float:
    """Value below which so many per cent of the magnitudes lie."""
    return df.agg(F.percentile(F.abs(F.col(feature)), percentile / 100).alias("p")).first()["p"]


def root_mean_square(df: DataFrame, feature: str) -> DataFrame:
    return df.agg(F.sqrt(F.avg(F.col(feature) * F.col(feature))).alias("rms"))


def skill(df: DataFrame, feature: str, by: tuple[str, ...]) -> DataFrame:
    """mean, std, skew, kurtosis (population, excess), zero_rate and percentiles 1 to 99 of a series."""
    levels = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    return df.groupBy(*by).agg(
        F.avg(feature).alias("mean"), F.stddev_pop(feature).alias("std"), F.skewness(feature).alias("skew"), F.kurtosis(feature).alias("kurtosis"),
        F.avg((F.col(feature) == 0).cast("double")).alias("zero_rate"), F.percentile(feature, levels).alias("percentiles"),
    )


def ks_distance(base: DataFrame, bias: DataFrame, feature: str, by: tuple[str, ...]) -> DataFrame:
    """Largest difference between two empirical distributions, by group: one union, one running count."""
    both = base.select(*by, F.col(feature).alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(bias.select(*by, F.col(feature).alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    steps = both.where("x is not null").groupBy(*by, "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w, whole = Window.partitionBy(*by).orderBy("x"), Window.partitionBy(*by)
    gap = F.abs(F.try_divide(F.sum("a").over(w), F.sum("a").over(whole)) - F.try_divide(F.sum("b").over(w), F.sum("b").over(whole)))
    return steps.withColumn("gap", gap).groupBy(*by).agg(F.max("gap").alias("ks"))


def ks_p_value(d: Column, n: Column, m: Column, terms: int = 20) -> Column:
    """Asymptotic two-sided p-value of the distance (the leading terms of Kolmogorov's series)."""
    size = F.sqrt(n * m / (n + m))
    x = (size + 0.12 + 0.11 / size) * d
    total = F.lit(0.0)
    for k in range(1, terms + 1):
        total = total + (2.0 if k % 2 else -2.0) * F.exp(-2.0 * k * k * x * x)
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def ols_no_intercept(df: DataFrame, y: str, x1: str, x2: str) -> DataFrame:
    """(w1, w2) of y ~ w1 x1 + w2 x2 from the sums of products."""
    s = {f"{a}{b}": F.sum(F.col(p) * F.col(q)) for a, b, p, q in (("1", "1", x1, x1), ("1", "2", x1, x2), ("2", "2", x2, x2), ("1", "y", x1, y), ("2", "y", x2, y))}
    t = df.agg(*[v.alias(f"s{k}") for k, v in s.items()])
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    return t.select(F.try_divide(F.col("s22") * F.col("s1y") - F.col("s12") * F.col("s2y"), det).alias("w1"), F.try_divide(F.col("s11") * F.col("s2y") - F.col("s12") * F.col("s1y"), det).alias("w2"))
