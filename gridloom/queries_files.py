"""Queries: array files written and read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .cubes import FEATURES, HISTORY_SQL, SITES_SQL, WIDE_SQL, cube_wide, histories, sites, table
from .finish import finish, n, r, t
from .operators.raster import time_index
from .queries import query
from .queries_more import _place
from .sources import index, sinks
from .sources.netcdf import read_netcdf, write_netcdf

_AXES = {"t_idx": "time", "south_north": "latitude", "west_east": "longitude"}


def _whole(spark, sf_dir):
    """The wide cube over the rows that it fills, with times numbered: every cell at every step."""
    cube = time_index(cube_wide(spark, sf_dir))
    full = cube.select("south_north", "west_east").distinct().groupBy("south_north").agg(F.count("*").alias("cells")).where("cells = 15")
    return cube.join(full.select("south_north"), "south_north").withColumn("south_north", F.col("south_north") - F.lit(full.agg(F.min("south_north")).first()[0]))


def _written(spark, sf_dir):
    path = f"{_place(spark).removeprefix('file:')}/cube.nc"
    variables = {**{c: [d] for d, c in _AXES.items()}, **{f: list(_AXES) for f in FEATURES}}
    write_netcdf(_whole(spark, sf_dir), path, list(_AXES), variables)
    return path


_FULL = f"""{WIDE_SQL},
filled as (select south_north from (select distinct south_north, west_east from wide) group by south_north having count(*) = 15),
least as (select min(south_north) low from filled),
whole as (select wide.* replace (south_north - (select low from least) as south_north), dense_rank() over (order by time) - 1 t_idx from wide where south_north in (select south_north from filled))"""
_VALUES = ", ".join(r(f, f) for f in FEATURES)


@query(f"with {_FULL} select {n('t_idx')}, {n('south_north')}, {n('west_east')}, {t('time')}, {r('latitude', 'latitude')}, {r('longitude', 'longitude')}, {_VALUES} from whole")
def netcdf_round_trip(spark, sf_dir):
    """The cube as one array file by all tasks, read back."""
    back = read_netcdf(spark, _written(spark, sf_dir)).withColumnsRenamed({f"{d}_idx": d for d in _AXES})
    return finish(back, *_AXES, *_AXES.values(), *FEATURES)


@query(f"""with {_FULL} select {n('t_idx')}, {n('south_north')}, {n('west_east')}, {t('time')}, {r('u_100m', 'u_100m')}
from whole where south_north >= 1 and south_north < 3 and longitude >= -103 and longitude <= -100 and t_idx >= 5 and t_idx < 12""")
def netcdf_crop(spark, sf_dir):
    """Two variables of a crop of an array file: ranges reach the scan as bytes to read."""
    df = read_netcdf(spark, _written(spark, sf_dir), ["u_100m"], partition_bytes=1 << 16)
    box = df.where("south_north_idx >= 1 and south_north_idx < 3 and longitude >= -103 and longitude <= -100 and t_idx_idx >= 5 and t_idx_idx < 12")
    return finish(box.withColumnsRenamed({f"{d}_idx": d for d in _AXES}), *_AXES, "time", "u_100m")


@query("""select count(*)::bigint "rows", count(*) filter (l_quantity is null)::bigint "nulls", 0::bigint over_limit, true as some_files from lineitem""")
def sized_files(spark, sf_dir):
    """Files of a data set whose size was aimed at: their own rows, and that none holds more than its bytes allow."""
    path = _place(spark)
    lines = table(spark, sf_dir, "lineitem")
    limit = sinks.write_sized(lines, path, 64 << 10, by=("l_suppkey",))
    files = sinks.written_files(spark, path)
    back = spark.read.parquet(path).agg(F.count("*").alias("rows"), F.count_if(F.col("l_quantity").isNull()).alias("nulls"))
    size = files.agg(F.count_if(F.col("rows") > limit).alias("over_limit"), (F.sum("rows") <= limit * F.count("*")).alias("some_files"))
    return back.crossJoin(size)


@query(f"""with {HISTORY_SQL}, {SITES_SQL},
f as (select gid, avg(x) m from base group by gid)
select {n("s.gid", "gid")}, {n("s.south_north", "south_north")}, {n("s.west_east", "west_east")}, {r("m", "mean")}, {n("count(b.x)", "values")}
from sites s join f on f.gid = s.gid left join bias b on b.gid = s.gid group by s.gid, s.south_north, s.west_east, m""")
def indexed_factors(spark, sf_dir):
    """Cells, factors and series kept in buckets of gid and joined on it without a shuffle."""
    observed, modelled, _ = histories(spark, sf_dir)
    names = [f"kept_{uuid.uuid4().hex}" for _ in range(3)]
    cells = index.keep_by_gid(sites(spark, sf_dir), names[0], buckets=8)
    factors = index.keep_by_gid(observed.groupBy("gid").agg(F.avg("x").alias("mean")), names[1], buckets=8)
    series = index.keep_by_gid(modelled, names[2], buckets=8).groupBy("gid").agg(F.count("x").alias("values"))
    joined = cells.join(factors, "gid").join(series, "gid", "left").withColumn("values", F.coalesce("values", F.lit(0)))
    return finish(joined, "gid", "south_north", "west_east", "mean", "values")
