"""Queries: padded chunks with exogenous fields through chains of models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .cubes import SMALL_SQL, cube_small, table
from .finish import finish, n, r, t
from .operators import chunks, models
from .operators.observations import Coverage, observed
from .operators.raster import time_index
from .plans.pairs import exo_steps
from .queries import query
from .queries_files import _FULL, _whole


def _smooth_and_double(x: np.ndarray) -> np.ndarray:
    """(steps, rows, columns, [value, height]): the mean of three columns plus a share of the height, twice as fine."""
    value, height = x[..., 0], np.nan_to_num(x[..., 1])
    mean = value.copy()
    mean[:, :, 1:-1] = (value[:, :, :-2] + value[:, :, 1:-1] + value[:, :, 2:]) / 3
    return np.repeat(np.repeat((mean + 0.001 * height)[..., None], 2, 1), 2, 2)


def _double_in_time(x: np.ndarray, layers: dict[str, np.ndarray]) -> np.ndarray:
    return np.repeat(x, 2, 2) + 0.01 * np.nan_to_num(layers["topography"])[..., None]


def _heights(spark, sf_dir, cells: int, columns: int):
    """(south_north, west_east, topography): means of balances dealt over the cells by customer."""
    place = F.pmod("c_custkey", F.lit(cells)).cast("int")
    means = table(spark, sf_dir, "customer").groupBy(place.alias("cell")).agg(F.avg("c_acctbal").alias("topography"))
    return means.select(F.floor(F.col("cell") / columns).cast("int").alias("south_north"), F.pmod("cell", F.lit(columns)).alias("west_east"), "topography")


@query(f"""with {_FULL}, height as (select max(south_north) + 1 rows from whole),
base as (select t_idx, south_north i, west_east j, coalesce(u_100m, 0) u from whole),
mean as (
  select t_idx, i, j, (coalesce(lag(u) over w, lead(u) over w) + u + coalesce(lead(u) over w, lag(u) over w)) / 3 s
  from base window w as (partition by t_idx, i order by j)),
coarse as (select c_custkey % (rows * 15) cell, avg(c_acctbal) h from customer, height group by 1),
fine as (select c_custkey % (4 * rows * 15) cell, avg(c_acctbal) h from customer, height group by 1),
spread as (select 2 * t_idx + dt t, 2 * i + di i, 2 * j + dj j, s + 0.001 * coalesce(h, 0) s
  from mean left join coarse on cell = 15 * i + j, unnest([0, 1]) a(di), unnest([0, 1]) b(dj), unnest([0, 1]) c(dt))
select {n("i", "south_north")}, {n("j", "west_east")}, {n("t", "t_idx")}, {r("s + 0.01 * coalesce(h, 0)", "y")} from spread left join fine on cell = 30 * i + j""")
def forward_pass_exo(spark, sf_dir):
    """Two models in a chain over padded chunks: topography is an input of the first and a layer of the second, each at its resolution."""
    cube = _whole(spark, sf_dir).withColumn("u_100m", F.coalesce("u_100m", F.lit(0.0)))
    top = cube.agg(F.max("south_north"), F.max("t_idx")).first()
    rows, steps = top[0] + 1, top[1] + 1
    wanted = exo_steps("topography", [(0, "input"), (1, "layer")], [2, 1], [1, 2])
    fields = [(w, _heights(spark, sf_dir, rows * 15 * w.s_enhance**2, 15 * w.s_enhance)) for w in wanted]
    chain = models.Chain([models.Step(_smooth_and_double, ("u_100m", "topography"), ("w",), 2, 1, True), models.Step(_double_in_time, ("w",), ("y",), 1, 2)], exo=wanted)
    layout = chunks.Layout((rows, 15, steps), (3, 4, 7), (1, 1, 1), (2, 2, 2))
    return finish(chunks.forward_pass(cube, chain.inputs, layout, chain, ["y"], exo=fields), "south_north", "west_east", "t_idx", "y")


@query("""with axis as (select * from (values ('i', 0, 0, 3, 1, 4), ('i', 1, 3, 4, 3, 4), ('j', 0, 0, 3, 1, 4), ('j', 1, 3, 4, 3, 4)) v(axis, chunk, a, b, pad, size)),
place as (select axis, chunk, k - a + pad place, case when k % 6 < 0 then k % 6 + 6 else k % 6 end m from axis, unnest(range(a - pad, b + pad)) t(k)),
spot as (select axis, chunk, place, least(m, 6 - m) source from place),
""" + SMALL_SQL + f"""
select {n("i.chunk * 2 + j.chunk", "s_chunk")}, {n("i.place", "i")}, {n("j.place", "j")}, {t("c.time")}, {r("c.ghi", "ghi")}
from cube c join spot i on i.axis = 'i' and i.source = c.south_north join spot j on j.axis = 'j' and j.source = c.west_east""")
def narrow_chunks(spark, sf_dir):
    """Every row of padded chunks whose last ones are one cell wide and get more overlap."""
    cube = time_index(cube_small(spark, sf_dir))
    steps = cube.agg(F.max("t_idx")).first()[0] + 1
    sent = chunks.with_halo(cube, chunks.Layout((4, 4, steps), (3, 3, steps), (1, 1, 0), least=(4, 4, 0)))
    return finish(sent, "s_chunk", "i", "j", "time", "ghi")


def _hours_of_inner_days(x: np.ndarray) -> np.ndarray:
    """The hours of all days but the outer two: a day's value times the hour's share of the daylight."""
    hours = np.maximum(0, 6 - np.abs(np.arange(24) - 11.5))
    return np.repeat(x[:, :, 1:-1], 24, 2) * np.tile(hours / 36, x.shape[2] - 2)[None, None, :, None]


@query(f"""with {_FULL} select {n("i.south_north", "south_north")}, {n("i.west_east", "west_east")}, {n("i.t_idx * 24 + h", "t_idx")},
{r("coalesce(ghi, 0) * greatest(0, 6 - abs(h - 11.5)) / 36", "ghi")} from whole i, unnest(range(24)) hours(h)""")
def forward_pass_hours(spark, sf_dir):
    """Hours from daily chunks by a model that gives those of the inner days; what it lacks is mirrored on and cut off with the overlap."""
    cube = _whole(spark, sf_dir).withColumn("ghi", F.coalesce("ghi", F.lit(0.0)))
    top = cube.agg(F.max("south_north"), F.max("t_idx")).first()
    layout = chunks.Layout((top[0] + 1, 15, top[1] + 1), (4, 5, 7), (0, 0, 1), (1, 1, 24))
    return finish(chunks.forward_pass(cube, ["ghi"], layout, models.WholeDays(_hours_of_inner_days), ["ghi"]), "south_north", "west_east", "t_idx", "ghi")


def _draw(*parts: str) -> str:
    return f"((('0x' || substr(md5({" || ':' || ".join(parts)}), 1, 8))::bigint + 0.5) / 4294967296.0::double)"


def _reports(kind: str, space: tuple[float, float], time: tuple[float, float]) -> str:
    of = lambda what, *more: _draw(f"'7:{kind} {what}'", "obs", *more)
    share = lambda what, s: f"least(greatest({s[0]}::double + {of(what)} * ({s[1]}::double - {s[0]}::double), 0), 1)"
    return f"({of('cell', 'south_north', 'west_east')} <= {share('space', space)} and {of('step', 't_idx')} <= {share('time', time)})"


@query(f"""with {_FULL}, x as (select *, (t_idx // 7)::varchar obs, 10 * west_east - 50 topography from whole)
select obs, {n("south_north")}, {n("west_east")}, {n("t_idx")}, {r("u_100m", "u_100m")},
{r(f"case when case when topography > 0 then {_reports('onshore', (0.3, 0.6), (0.8, 0.8))} else {_reports('offshore', (0.1, 0.2), (0.5, 1))} end then u_100m end", "u_100m_obs")} from x""")
def observed_cells(spark, sf_dir):
    """Wind as stations see it, week by week: more of the land (east of the sixth column) than of the sea."""
    cube = _whole(spark, sf_dir).withColumns({"obs": F.floor(F.col("t_idx") / 7).cast("string"), "topography": 10 * F.col("west_east") - 50})
    seen = observed(cube, ["u_100m"], Coverage((0.3, 0.6), 0.8), Coverage((0.1, 0.2), (0.5, 1.0)), seed=7)
    return finish(seen, "obs", "south_north", "west_east", "t_idx", "u_100m", "u_100m_obs")
