"""Classic NetCDF: headers made by hand, byte ranges, and what a sink leaves behind."""

import datetime as dt
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

from gridloom.sources import netcdf as N


def text(s):
    return struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)


def by_hand():
    """A file of version 1: records of time (double), p (short, scaled, padded) and x (float), and latitudes of two rows."""
    def header(begin):
        units, scale, add = "hours since 2001-02-28 00:00:00", struct.pack(">d", 0.5), struct.pack(">d", 10.0)
        return b"".join([
            b"CDF\x01", struct.pack(">i", 3),
            struct.pack(">ii", 0x0A, 3), text("time"), struct.pack(">i", 0), text("y"), struct.pack(">i", 2), text("x"), struct.pack(">i", 3),
            struct.pack(">ii", 0x0C, 1), text("title"), struct.pack(">i", 2), text("by hand"),
            struct.pack(">ii", 0x0B, 4),
            text("lat"), struct.pack(">ii", 1, 1), struct.pack(">ii", 0, 0), struct.pack(">iii", 5, 8, begin),
            text("time"), struct.pack(">ii", 1, 0), struct.pack(">ii", 0x0C, 2), text("units"), struct.pack(">i", 2), text(units), text("calendar"), struct.pack(">i", 2), text("noleap"), struct.pack(">iii", 6, 8, begin + 8),
            text("p"), struct.pack(">ii", 1, 0), struct.pack(">ii", 0x0C, 2), text("scale_factor"), struct.pack(">ii", 6, 1), scale, text("add_offset"), struct.pack(">ii", 6, 1), add, struct.pack(">iii", 3, 4, begin + 16),
            text("v"), struct.pack(">iiii", 3, 0, 1, 2), struct.pack(">ii", 0, 0), struct.pack(">iii", 5, 24, begin + 20),
        ])
    raw = header(len(header(0)))
    raw += struct.pack(">2f", 40.0, 39.5)
    for k in range(3):
        raw += struct.pack(">d", 24.0 * k) + struct.pack(">hh", (4, -32767, 6)[k], 0)
        raw += np.array([[k * 10 + i * 3 + j for j in range(3)] for i in range(2)], ">f4").tobytes()
    return raw


@pytest.fixture
def file(tmp_path):
    path = tmp_path / "hand.nc"
    path.write_bytes(by_hand())
    return str(path)


def test_header_and_records(spark, file):
    h = N.header_of(file)
    assert (h.dims, h.record, h.record_bytes, h.attributes["title"]) == ({"time": 3, "y": 2, "x": 3}, "time", 36, "by hand")
    rows = N.read_netcdf(spark, file).orderBy("time_idx", "y_idx", "x_idx").collect()
    assert [r["v"] for r in rows] == [float(k * 10 + c) for k in range(3) for c in range(6)]
    assert [r["p"] for r in rows[::6]] == [12.0, None, 13.0] and {r["lat"] for r in rows} == {40.0, 39.5}
    assert [r["time"] for r in rows[::6]] == [dt.datetime(2001, 2, 28), dt.datetime(2001, 3, 1), dt.datetime(2001, 3, 2)]


def test_a_calendar_without_leap_days():
    v = N.Variable("time", ("time",), ">f8", 0, {"units": "days since 2003-12-31", "calendar": "365_day"})
    values, _ = N.decoded(v, np.array([0, 1, 59, 60, 61, 365 + 1], ">f8"))
    assert values.astype("datetime64[D]").astype(str).tolist() == ["2003-12-31", "2004-01-01", "2004-02-28", "2004-03-01", "2004-03-02", "2005-01-01"]


def test_only_the_bytes_of_the_crop_are_read(file):
    reader = N.NetCDFReader([file], N.schema_of(N.header_of(file)), 1 << 20)
    left = list(reader.pushFilters([EqualTo(("y_idx",), 1), GreaterThanOrEqual(("time",), dt.datetime(2001, 3, 1)), LessThan(("x_idx",), 2), EqualTo(("v",), 3.0)]))
    assert [type(f) for f in left] == [EqualTo] and left[0].attribute == ("v",)
    (piece,) = reader.partitions()
    assert piece.ranges == {"time": (1, 3), "y": (1, 2), "x": (0, 2)}
    raw, asked = by_hand(), []

    def read(at, n):
        asked.append((at, at + n))
        return raw[at : at + n]

    (batch,) = N.batches_of(read, piece.header, piece.ranges, reader.schema)
    assert batch.column("v").to_pylist() == [13.0, 14.0, 23.0, 24.0]
    v = piece.header.variables["v"]
    of_v = [a for a in asked if a[0] >= v.begin and a[1] - a[0] == 12]
    assert of_v == [(v.begin + k * 36 + 12, v.begin + k * 36 + 24) for k in (1, 2)]  # the second row of two records
    assert all(not (a < v.begin + 24 and b > v.begin) for a, b in asked)  # nothing of the first record


def test_a_scan_is_dealt_by_bytes(file):
    h = N.header_of(file)
    reader = N.NetCDFReader([file], N.schema_of(h), 12)
    pieces = reader.partitions()
    assert len(pieces) == 6 and {(p.ranges["time"], p.ranges["y"]) for p in pieces} == {((k, k + 1), (i, i + 1)) for k in range(3) for i in range(2)}
    with pytest.raises(ValueError, match="lacks"):
        N.NetCDFReader([file], N.schema_of(h).add("other", "float"), 12)


def test_what_is_no_classic_file_raises(tmp_path):
    (tmp_path / "no.nc").write_bytes(b"\x89HDF\r\n\x1a\n" + b"\0" * 64)
    with pytest.raises(ValueError, match="not a classic"):
        N.header_of(str(tmp_path / "no.nc"))
    (tmp_path / "cut.nc").write_bytes(by_hand()[:100])
    with pytest.raises(ValueError, match="too early"):
        N.header_of(str(tmp_path / "cut.nc"))


def cells(spark, steps=5):
    df = spark.range(steps * 4 * 3).select(
        (F.col("id") / 12).cast("int").alias("t_idx"), (F.col("id") / 3 % 4).cast("int").alias("south_north"), (F.col("id") % 3).cast("int").alias("west_east"), "id")
    return df.withColumns({"v": F.when(F.col("id") % 7 != 0, F.col("id") * 1.5), "latitude": 40 - 0.5 * F.col("south_north"), "n": F.col("id").cast("int"), "time": F.timestamp_seconds(F.col("t_idx") * 3600)}).repartition(3)


AXES = ["t_idx", "south_north", "west_east"]
OVER = {"v": AXES, "n": AXES, "latitude": ["south_north"], "time": ["t_idx"]}


def test_round_trip_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "out" / "cube.nc")
    df = cells(spark)
    N.write_netcdf(df, path, AXES, OVER, {"v": {"units": "m s-1"}})
    assert N.header_of(path).variables["v"].attributes["units"] == "m s-1"
    back = N.read_netcdf(spark, path, partition_bytes=64).withColumnsRenamed({f"{a}_idx": a for a in AXES}).select(*AXES, "v", "n", "latitude", "time")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.select(*AXES, "v", "n", "latitude", "time").collect()))
    assert back.rdd.getNumPartitions() > 3 and os.listdir(tmp_path / "out") == ["cube.nc"]
    with pytest.raises(Exception, match="FileExistsError|exists"):
        N.write_netcdf(df, path, AXES, OVER)
    N.write_netcdf(df.withColumn("n", F.lit(7)), path, AXES, OVER, overwrite=True)
    assert N.read_netcdf(spark, path, ["n"]).where("n = 7").count() == 60 and "v" not in N.read_netcdf(spark, path, ["n"]).columns


def test_a_failed_task_or_a_missing_cell_leaves_nothing(spark, tmp_path):
    bad = cells(spark).withColumn("v", F.when(F.col("id") == 41, F.raise_error(F.lit("a task fails")).cast("double")).otherwise(F.col("v")))
    for df, says in ((bad, "a task fails"), (cells(spark).where("id != 17"), "missing"), (cells(spark).union(cells(spark).where("id = 5")), "twice")):
        with pytest.raises(Exception, match=says):
            N.write_netcdf(df, str(tmp_path / "cube.nc"), {"t_idx": 5, "south_north": 4, "west_east": 3}, OVER)
        assert os.listdir(tmp_path) == []


def test_large_variables_take_the_wide_format():
    raw, h, size = N.lay_out({"t": 1 << 20, "y": 1 << 10}, {"v": {"dims": ["t", "y"], "type": "float"}})
    assert raw[:4] == b"CDF\x05" and size == len(raw) + (1 << 32) and h.variables["v"].begin == len(raw)
    assert N.lay_out({"t": 4}, {"v": {"dims": ["t"], "type": "int"}})[0][:4] == b"CDF\x02"
