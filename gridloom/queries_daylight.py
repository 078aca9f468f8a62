"""Queries: windows centred on daylight, and chunks of local hours as hours of UTC."""

from __future__ import annotations

from pyspark.sql import functions as F

from .cubes import table
from .finish import finish, n, r
from .operators import sampling, solar
from .queries import query

_HOURS = """ev as (select date_diff('hour', (select date_trunc('day', min(ts)) from events), date_trunc('hour', ts)) t_idx, event_type, value from events),
span as (select (max(t_idx) // 24 + 1) * 24 steps from ev),
m as (select t_idx, avg(value) filter (event_type = 'purchase' and t_idx % 24 between 6 and 18) clearsky_ratio from ev group by t_idx),
hours as (select t.t_idx, clearsky_ratio from span, unnest(range(0, steps)) t(t_idx) left join m on m.t_idx = t.t_idx)"""


def _hours(spark, sf_dir):
    """(t_idx, clearsky_ratio): an hour series of whole days; night is before six, after six, and hours without purchases."""
    events = table(spark, sf_dir, "events")
    first = F.date_trunc("day", F.lit(events.agg(F.min("ts")).first()[0]))
    hour = F.floor((F.unix_seconds(F.date_trunc("hour", "ts")) - F.unix_seconds(first)) / 3600).cast("int")
    placed = events.withColumn("t_idx", hour)
    bought = F.when((F.col("event_type") == "purchase") & (F.col("t_idx") % 24).between(6, 18), F.col("value"))
    means = placed.groupBy("t_idx").agg(F.avg(bought).alias("clearsky_ratio"))
    days = placed.agg(F.max("t_idx")).first()[0] // 24 + 1
    return spark.range(days * 24).select(F.col("id").cast("int").alias("t_idx")).join(means, "t_idx", "left")


_WINDOWS = """steps as (select t_idx, t_idx // 24 as day, clearsky_ratio is null night from hours),
d as (select day, min(t_idx) filter (not night) first_light, count(*) filter (not night) light from steps group by day),
w as (select day, first_light, light, greatest(0, least(coalesce(first_light - round_even((10 - light) / 2.0, 0), day * 24), steps - case when first_light is null then 24 else 10 end))::int as start,
  case when first_light is null then 24 else 10 end size from d, span)"""


@query(f"""with {_HOURS}, {_WINDOWS} select day::bigint as day, {n("first_light")}, {n("light")}, {n("start")}, {n("start + size", "stop")} from w""")
def daylight_windows(spark, sf_dir):
    """Ten hours of each day, centred on its daylight."""
    return finish(sampling.daylight_windows(_hours(spark, sf_dir), 10), "day", "first_light", "light", "start", "stop")


@query(f"""with {_HOURS}, {_WINDOWS} select day::bigint as day, {n("t_idx - start", "t")}, {n("t_idx")}, {r("clearsky_ratio", "clearsky_ratio")} from w, hours where t_idx >= start and t_idx < start + size""")
def daylight_samples(spark, sf_dir):
    hours = _hours(spark, sf_dir)
    return finish(sampling.daylight_samples(hours, sampling.daylight_windows(hours, 10)), "day", "t", "t_idx", "clearsky_ratio")


_LOCAL = """site as (select s_suppkey gid, s_suppkey % 2 s_chunk, -120 + 15 * (s_suppkey % 17) longitude from supplier),
local_ as (
  select gid, s_chunk, longitude, t_idx // 24 t_chunk, t_idx % 24 as hour, clearsky_ratio * (1 + gid) x
  from site, hours where t_idx < 24 * 6)"""


@query(f"""with {_HOURS}, {_LOCAL},
c as (select distinct s_chunk, t_chunk from local_),
axis as (select s_chunk, t_chunk target, list_filter([lag(t_chunk) over w, t_chunk, lead(t_chunk) over w], lambda x: x is not null) files, case when lag(t_chunk) over w is null then 0 else 24 end start
  from c window w as (partition by s_chunk order by t_chunk)),
rolled as (
  select l.s_chunk, target t_chunk, gid, ((list_position(files, l.t_chunk) - 1) * 24 + hour - round_even(longitude / 15.0, 0)::int + 24 * len(files)) % (24 * len(files)) - start as hour, x
  from axis join local_ l on l.s_chunk = axis.s_chunk and list_contains(files, l.t_chunk))
select {n("s_chunk")}, {n("t_chunk")}, {n("gid")}, hour::bigint as hour, {r("x", "x")} from rolled where hour >= 0 and hour < 24 and t_chunk <> 2""")
def utc_by_chunk(spark, sf_dir):
    """Days of local hours at sites as days of UTC, each from three chunks; one day is there already and left out."""
    site = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("gid"), F.pmod("s_suppkey", F.lit(2)).alias("s_chunk"), (-120 + 15 * F.pmod("s_suppkey", F.lit(17))).alias("longitude"))
    hours = _hours(spark, sf_dir).where("t_idx < 24 * 6")
    local = site.crossJoin(F.broadcast(hours)).select("gid", "s_chunk", "longitude", F.floor(F.col("t_idx") / 24).cast("int").alias("t_chunk"), (F.col("t_idx") % 24).alias("hour"), (F.col("clearsky_ratio") * (1 + F.col("gid"))).alias("x"))
    todo = local.select("t_chunk").distinct().where("t_chunk <> 2")
    return finish(solar.to_utc_by_chunk(local, ["x"], ids=todo), "s_chunk", "t_chunk", "gid", "hour", "x")
