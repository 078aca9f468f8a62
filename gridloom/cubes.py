"""Cubes and site series made from the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import make_importable

#: Feature of the cube by the event type whose mean value it is.
FEATURES = {"u_100m": "click", "v_100m": "view", "ghi": "purchase", "clearsky_ghi": "signup", "temperature_2m": "error"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return make_importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _cube(events: DataFrame, gid, columns: int) -> DataFrame:
    """Every cell that occurs at every day that occurs; means of the day's events, null where there are none."""
    ev = events.select(gid.alias("gid"), F.date_trunc("day", "ts").alias("time"), "event_type", "value")
    means = ev.groupBy("gid", "time").agg(*[F.avg(F.when(F.col("event_type") == e, F.col("value"))).alias(f) for f, e in FEATURES.items()])
    cells = ev.select("gid").distinct().crossJoin(F.broadcast(ev.select("time").distinct()))
    i, j = F.floor(F.col("gid") / columns).cast("int"), F.pmod("gid", F.lit(columns)).cast("int")
    placed = cells.join(means, ["gid", "time"], "left").withColumns({"south_north": i, "west_east": j})
    return placed.withColumns({"latitude": 40 - 0.5 * F.col("south_north"), "longitude": -105 + 0.5 * F.col("west_east")})


def cube_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 by 4 cells by day."""
    return _cube(table(spark, sf_dir, "events"), F.pmod("user_id", F.lit(16)), 4)


def cube_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cell a user, 15 to a row, by day; many gaps."""
    return _cube(table(spark, sf_dir, "events"), F.col("user_id"), 15)


def _cube_sql(name: str, gid: str, columns: int) -> str:
    means = ", ".join(f"avg(value) filter (event_type = '{e}') {f}" for f, e in FEATURES.items())
    return f"""{name}_ev as (select {gid} gid, date_trunc('day', ts) as time, event_type, value from events),
{name}_m as (select gid, time, {means} from {name}_ev group by gid, time),
{name} as (select c.gid, d.time, {", ".join(FEATURES)}, (c.gid // {columns}) south_north, (c.gid % {columns}) west_east,
  40 - 0.5 * (c.gid // {columns}) latitude, -105 + 0.5 * (c.gid % {columns}) longitude
  from (select distinct gid from {name}_ev) c cross join (select distinct time from {name}_ev) d left join {name}_m m on m.gid = c.gid and m.time = d.time)"""


SMALL_SQL = _cube_sql("cube", "user_id % 16", 4)
WIDE_SQL = _cube_sql("wide", "user_id", 15)


def history(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    """(gid, time, x): quantities of one return flag by supplier and shipping date; N: observed, R: modelled, A: future."""
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag)
    return lines.select(F.col("l_suppkey").alias("gid"), F.col("l_shipdate").alias("time"), F.col("l_quantity").alias("x"))


def histories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return history(spark, sf_dir, "N"), history(spark, sf_dir, "R"), history(spark, sf_dir, "A")


HISTORY_SQL = ",\n".join(f"{n} as (select l_suppkey gid, l_shipdate as time, l_quantity x from lineitem where l_returnflag = '{f}')" for n, f in (("base", "N"), ("bias", "R"), ("fut", "A")))


def placed(start: str, step: str, k: Column) -> Column:
    """start + step * k in decimals, as SQL's literals are: distances that are equal stay equal."""
    return (F.lit(Decimal(start)) + F.lit(Decimal(step)) * k.cast("decimal(10,0)")).cast("decimal(14,5)")


def sites(spark: SparkSession, sf_dir: str, exact: bool = False) -> DataFrame:
    """(gid, south_north, west_east, latitude, longitude) of the suppliers, five to a row; ``exact``: coordinates are decimals."""
    i, j = F.floor(F.col("s_suppkey") / 5), F.pmod("s_suppkey", F.lit(5))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("gid"), i.cast("int").alias("south_north"), j.cast("int").alias("west_east"), (placed("40", "-0.1", i) if exact else 40 - 0.1 * i).alias("latitude"), (placed("-105", "0.1", j) if exact else -105 + 0.1 * j).alias("longitude"))


SITES_SQL = "sites as (select s_suppkey gid, s_suppkey // 5 south_north, s_suppkey % 5 west_east, 40 - 0.1 * (s_suppkey // 5) latitude, -105 + 0.1 * (s_suppkey % 5) longitude from supplier)"


def in_debt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid): suppliers with a negative balance."""
    return table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("gid"))


def of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid): suppliers of the first twelve nations."""
    return table(spark, sf_dir, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("gid"))


def scattered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, latitude, longitude, x): customers strewn over the suppliers' area by arithmetic of their keys; coordinates are decimals."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("gid"), placed("40.2", "-0.00231", F.pmod(k * 37, F.lit(1009))).alias("latitude"), placed("-105.2", "0.00087", F.pmod(k * 53, F.lit(997))).alias("longitude"), F.col("c_acctbal").alias("x"))


SCATTERED_SQL = "pts as (select c_custkey gid, 40.2 - ((c_custkey * 37) % 1009) * 0.00231 latitude, -105.2 + ((c_custkey * 53) % 997) * 0.00087 longitude, c_acctbal x from customer)"
