"""The distance transform behind the nearest fill, against brute force."""

import random

import numpy as np
import pytest

from gridloom.operators.windows import fill_nearest, interpolate_na, nearest_columns


def test_the_envelope_is_the_least_parabola_everywhere():
    rng = np.random.default_rng(5)
    for rows, columns in ((1, 1), (4, 2), (9, 31), (3, 60)):
        none, weight = 1 << 60, 10_000
        cost = weight * rng.integers(0, 40, (rows, columns)) ** 2 + rng.permutation(rows * columns).reshape(rows, columns)
        cost[rng.random((rows, columns)) < 0.4] = none
        got = nearest_columns(cost.astype(np.int64), none, weight)
        for r in range(rows):
            for x in range(columns):
                open_ = [q for q in range(columns) if cost[r, q] < none]
                assert got[r, x] == (min(open_, key=lambda q: weight * (x - q) ** 2 + int(cost[r, q])) if open_ else -1)


def brute(cells):
    filled = [(i, j, v) for (i, j), v in cells.items() if v is not None]
    return {(i, j): v if v is not None or not filled else min(filled, key=lambda f: ((f[0] - i) ** 2 + (f[1] - j) ** 2, f[0], f[1]))[2] for (i, j), v in cells.items()}


@pytest.mark.parametrize("share", [0.5, 0.05])
def test_every_gap_takes_the_nearest_value(spark, share):
    rng = random.Random(share)
    fields = {}
    for t in range(4):  # cells of a field may be absent; the last one has no value at all
        fields[t] = {(i, j): (rng.random() if t < 3 and rng.random() < share else None) for i in range(70) for j in range(40) if rng.random() < 0.8}
    rows = [(t, i, j, v) for t, cells in fields.items() for (i, j), v in cells.items()]
    df = spark.createDataFrame(rows, "time int, south_north int, west_east int, v double").repartition(3)
    got = {(r["time"], r["south_north"], r["west_east"]): r["v"] for r in fill_nearest(df, "v").collect()}
    assert got == {(t, i, j): v for t, cells in fields.items() for (i, j), v in brute(cells).items()}


def test_one_value_fills_a_large_field(spark):
    df = spark.range(400 * 300).selectExpr("0 as time", "cast(id / 300 as int) as south_north", "cast(id % 300 as int) as west_east", "if(id = 5017, 3.5, null) as v")
    assert fill_nearest(df, "v").selectExpr("count(*)", "min(v)", "max(v)", "count(v)").first() == (120000, 3.5, 3.5, 120000)
    assert fill_nearest(df.limit(0), "v").count() == 0


def test_long_columns_are_filled_in_steps_linear_in_their_rows(spark):
    n = 120_000
    df = spark.range(n).selectExpr("0 as time", "cast(id as int) as south_north", "0 as west_east", f"if(id in (7, {n - 9}), cast(id as double), null) as v")
    filled = fill_nearest(df, "v")
    assert "unboundedfollowing" not in filled._jdf.queryExecution().optimizedPlan().toString().lower()
    near = filled.selectExpr(f"count_if(v = if(south_north - 7 <= {n - 9} - south_north, 7, {n - 9}))").first()[0]
    assert near == n


def test_series_take_the_values_behind_a_gap_without_a_frame_to_the_end(spark):
    df = spark.createDataFrame([(0, 0, t, x) for t, x in enumerate([None, 2.0, None, None, 8.0, 9.0, None])], "south_north int, west_east int, t_idx int, x double")
    filled = interpolate_na(df, "x")
    assert "unboundedfollowing" not in filled._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [r["x"] for r in filled.orderBy("t_idx").collect()] == [0.0, 2.0, 4.0, 6.0, 8.0, 9.0, 10.0]
