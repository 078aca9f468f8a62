"""Training samples and batches: boxes and times drawn on the driver become range filters."""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def uniform_start(size: int, length: int, rng: random.Random) -> int:
    if length > size:
        raise ValueError(f"a sample of {length} does not fit in {size}")
    return rng.randrange(size - length + 1)


def bins_of(count: int, n: int) -> list[range]:
    """``count`` starts in ``n`` near-equal runs, longer ones first."""
    base, more = divmod(count, n)
    out, at = [], 0
    for k in range(n):
        size = base + (k < more)
        out.append(range(at, at + size))
        at += size
    return out


def weighted_start(size: int, length: int, weights: list[float], rng: random.Random) -> int:
    """A start in a bin chosen by weight."""
    bins = bins_of(size - length + 1, len(weights))
    usable = [(b, w) for b, w in zip(bins, weights, strict=True) if len(b)]
    chosen = rng.choices([b for b, _ in usable], [w for _, w in usable])[0]
    return rng.choice(chosen)


def weighted_box(rows: int, columns: int, shape: tuple[int, int], weights: list[float], rng: random.Random) -> tuple[int, int]:
    """Upper left corner of a box; bins run over the corners row by row."""
    high, wide = rows - shape[0] + 1, columns - shape[1] + 1
    bins = [b for b in bins_of(high * wide, len(weights))]
    chosen = rng.choices(bins, weights)[0] if all(len(b) for b in bins) else range(high * wide)
    return divmod(rng.choice(chosen), wide)


def day_start(steps: int, days: int, rng: random.Random, per_day: int = 24) -> int:
    """The first step of a run of whole days."""
    return per_day * uniform_start(steps // per_day, days, rng)


def daylight_windows(df: DataFrame, length: int, ratio: str = "clearsky_ratio", per_day: int = 24) -> DataFrame:
    """(day, first_light, light, start, stop): for each day of ``t_idx`` steps the ``length`` steps centred on its daylight.

    A step is night where any cell's ``ratio`` is null or NaN. The window begins half of what the daylight lacks (rounded to even) before its first
    step; it may begin the day before. A day without daylight is taken whole, as is any if ``length`` reaches the day's.
    Windows are held within the steps there are.
    """
    night = F.max((F.col(ratio).isNull() | F.isnan(ratio)).cast("int"))
    steps = df.groupBy("t_idx").agg(night.alias("night")).withColumn("day", F.floor(F.col("t_idx") / per_day).cast("int"))
    by_day = steps.groupBy("day").agg(F.min(F.when(F.col("night") == 0, F.col("t_idx"))).alias("first_light"), F.sum(1 - F.col("night")).cast("int").alias("light"))
    count = steps.agg((F.max("t_idx") + 1).alias("steps"))
    whole = F.col("first_light").isNull() | F.lit(length >= per_day)
    begin = F.when(whole, F.col("day") * per_day).otherwise(F.col("first_light") - F.rint((F.lit(length) - F.col("light")) / 2).cast("int"))
    size = F.when(whole, per_day).otherwise(length)
    placed = by_day.crossJoin(F.broadcast(count)).withColumns({"start": begin, "size": F.least(size, F.col("steps"))})
    held = F.greatest(F.lit(0), F.least(F.col("start"), F.col("steps") - F.col("size")))
    return placed.withColumn("start", held).select("day", "first_light", "light", "start", (F.col("start") + F.col("size")).alias("stop"))


def daylight_samples(df: DataFrame, windows: DataFrame, days: list[int] | None = None) -> DataFrame:
    """Rows of each day's window with ``day`` and their place ``t`` in it; a step that two windows hold comes twice. ``days``: those drawn alone."""
    chosen = windows if days is None else windows.where(F.col("day").isin(days))
    steps = chosen.select("day", F.posexplode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("t", "t_idx"))
    return df.join(F.broadcast(steps), "t_idx")


def draw_days(days: int, observations: int, rng: random.Random) -> list[int]:
    """Days of a batch, one an observation; one may come again."""
    return [rng.randrange(days) for _ in range(observations)]


def loss_weights(losses: DataFrame, bin_column: str, value: str = "loss") -> DataFrame:
    """(bin, weight): mean loss of each bin over their total."""
    means = losses.groupBy(bin_column).agg(F.avg(value).alias("weight"))
    return means.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(0))))


def cut_samples(df: DataFrame, row: int, column: int, step: int, shape: tuple[int, int, int], observations: int = 1) -> DataFrame:
    """One box over ``observations`` times as many steps, dealt into observations: one range scan, whatever their number."""
    box = df.where(
        F.col("south_north").between(row, row + shape[0] - 1) & F.col("west_east").between(column, column + shape[1] - 1) & F.col("t_idx").between(step, step + shape[2] * observations - 1)
    )
    at = F.col("t_idx") - step
    return box.withColumns({
        "obs": F.floor(at / shape[2]).cast("int"), "i": F.col("south_north") - row, "j": F.col("west_east") - column, "t": F.pmod(at, F.lit(shape[2])).cast("int"),
    })


def pair_samples(low: DataFrame, high: DataFrame, row: int, column: int, step: int, shape: tuple[int, int, int], s: int, t: int) -> tuple[DataFrame, DataFrame]:
    """The same box of a coarse cube and of one ``s`` and ``t`` times as fine."""
    return cut_samples(low, row, column, step, shape), cut_samples(high, row * s, column * s, step * t, (shape[0] * s, shape[1] * s, shape[2] * t))


def align(low: DataFrame, high: DataFrame, features: list[str], s: int, t: int) -> DataFrame:
    """Each fine row with its coarse cell's features (``f_low``)."""
    keys = {"south_north": s, "west_east": s, "t_idx": t}
    fine = high.withColumns({f"_{k}": F.floor(F.col(k) / n).cast("int") for k, n in keys.items()})
    coarse = low.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(f).alias(f"{f}_low") for f in features])
    return fine.join(coarse, [f"_{k}" for k in keys]).drop(*[f"_{k}" for k in keys])


def moment_targets(both: DataFrame, feature: str, expected: str | None = None) -> DataFrame:
    """Targets of conditional moments for a fine feature, its coarse value repeated (``f_low``) and its expectation.

    mom1: x; mom1_sf: x - low; mom2: (x - e)^2; mom2_sep: x^2; mom2_sf: (x - low - e)^2; mom2_sep_sf: (x - low)^2.
    """
    x, low = F.col(feature), F.col(f"{feature}_low")
    e = F.col(expected) if expected else F.lit(0.0)
    sub = x - low
    return both.withColumns({"mom1": x, "mom1_sf": sub, "mom2": (x - e) * (x - e), "mom2_sep": x * x, "mom2_sf": (sub - e) * (sub - e), "mom2_sep_sf": sub * sub})


@dataclass
class BatchQueue:
    """Batches of coarse and fine samples from containers, chosen by their sizes.

    A container is (frame with t_idx, rows, columns, steps). ``transform`` makes the coarse sample
    from the fine one: s and t coarsening by method. With weights, starts are drawn by bin.
    """

    containers: list[tuple[DataFrame, int, int, int]]
    features: list[str]
    shape: tuple[int, int, int]
    s: int = 1
    t: int = 1
    method: str = "average"
    batch_size: int = 4
    n_batches: int = 1
    seed: int = 42
    time_weights: list[float] | None = None
    space_weights: list[float] | None = None
    smoothing: float = 0.0  # width in coarse cells; 0 for none
    smoothing_ignore: tuple[str, ...] = ()
    rng: random.Random = field(init=False)

    def __post_init__(self):
        self.rng = random.Random(self.seed)

    def draw(self) -> tuple[int, int, int, int]:
        """(container, row, column, step) of the next sample."""
        sizes = [r * c * n for _, r, c, n in self.containers]
        k = self.rng.choices(range(len(sizes)), sizes)[0]
        _, rows, columns, steps = self.containers[k]
        if self.space_weights:
            row, column = weighted_box(rows, columns, self.shape[:2], self.space_weights, self.rng)
        else:
            row, column = uniform_start(rows, self.shape[0], self.rng), uniform_start(columns, self.shape[1], self.rng)
        step = weighted_start(steps, self.shape[2], self.time_weights, self.rng) if self.time_weights else uniform_start(steps, self.shape[2], self.rng)
        return k, row, column, step

    def batch(self) -> tuple[DataFrame, DataFrame]:
        """(coarse, fine): rows keyed by obs, south_north, west_east, t_idx."""
        fine = None
        for obs in range(self.batch_size):
            k, row, column, step = self.draw()
            sample = cut_samples(self.containers[k][0], row, column, step, self.shape)
            sample = sample.select(F.lit(obs).alias("obs"), F.col("i").alias("south_north"), F.col("j").alias("west_east"), F.col("t").alias("t_idx"), *self.features)
            fine = sample if fine is None else fine.unionByName(sample)
        return self._coarse(fine, ("obs",)), fine

    def _coarse(self, fine: DataFrame, by: tuple[str, ...]) -> DataFrame:
        """The coarse members of samples, smoothed if asked."""
        from .coarsen import spatial, temporal
        from .windows import smooth

        coarse = spatial(fine, self.features, self.s, by=(*by, "t_idx")) if self.s > 1 else fine
        if self.t > 1:
            coarse = temporal(coarse, self.features, self.t, self.method, by=(*by, "south_north", "west_east")).withColumnRenamed("t_block", "t_idx")
        if self.smoothing:
            keys = [*by, "t_idx", "south_north", "west_east"]
            for f in self.features:
                if f not in self.smoothing_ignore:
                    blurred = smooth(coarse.select(*keys, f), f, self.smoothing, self.shape[0] // self.s, self.shape[1] // self.s, (*by, "t_idx"))
                    coarse = coarse.drop(f).join(blurred, keys)
        return coarse

    def epoch(self) -> tuple[DataFrame, DataFrame]:
        """(coarse, fine) of all batches as one plan: the draws become a table of cells that is joined with each container once; ``batch`` numbers them."""
        drawn: dict[int, list[tuple[int, ...]]] = {}
        for b in range(self.n_batches):
            for obs in range(self.batch_size):
                k, *corner = self.draw()
                drawn.setdefault(k, []).append((b, obs, *corner))
        fine = None
        for k, rows in sorted(drawn.items()):
            df = self.containers[k][0]
            cells = df.sparkSession.createDataFrame(rows, "batch int, obs int, _row int, _column int, _step int")
            for name, first, size in (("i", "_row", self.shape[0]), ("j", "_column", self.shape[1]), ("t", "_step", self.shape[2])):
                cells = cells.withColumn(f"_{name}", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn(first, F.col(first) + F.col(f"_{name}"))
            here = cells.withColumnsRenamed({"_row": "south_north", "_column": "west_east", "_step": "t_idx"}).join(df, ["south_north", "west_east", "t_idx"])
            here = here.select("batch", "obs", F.col("_i").alias("south_north"), F.col("_j").alias("west_east"), F.col("_t").alias("t_idx"), *self.features)
            fine = here if fine is None else fine.unionByName(here)
        return self._coarse(fine, ("batch", "obs")), fine

    def __iter__(self) -> Iterator[tuple[DataFrame, DataFrame]]:
        for _ in range(self.n_batches):
            yield self.batch()


def validation_bins(count: int, n_space: int, n_time: int) -> tuple[int, int]:
    """Space and time bin of the ``count``-th validation batch: all pairs in turn."""
    return (count // n_time) % n_space, count % n_time


def observed(df: DataFrame, features: list[str], share: float, seed: int) -> DataFrame:
    """``f_obs``: the feature at a random share of cells, else null; one draw a cell."""
    cells = df.select("south_north", "west_east").distinct()
    chosen = cells.withColumn("_o", F.pmod(F.xxhash64(F.lit(seed), "south_north", "west_east"), F.lit(1_000_000)) < int(share * 1_000_000))
    return df.join(chosen, ["south_north", "west_east"]).withColumns({f"{f}_obs": F.when(F.col("_o"), F.col(f)) for f in features}).drop("_o")
