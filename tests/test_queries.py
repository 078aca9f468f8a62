"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from gridloom.queries import FLAGSHIP, QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    return con


def plain(rows):
    return sorted(str(["" if v is None else f"{v:.7g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = plain(tuple(r) for r in df.select(*columns).collect())
    if name in SQL:
        inner = ", ".join(f'"{c}"' for c in columns)
        assert rows == plain(duck.execute(f"select {inner} from ({SQL[name]}) q").fetchall())
    else:
        assert rows


@pytest.mark.parametrize("name", ["clearsky_by_day_all", "matched_clearsky_all", "paired_histories_all"])
def test_every_cell_and_site(spark, sf_dir, duck, name):
    all_ = "select distinct user_id % 16 from events" if name == "clearsky_by_day_all" else "select distinct l_suppkey from lineitem where l_returnflag = 'N'"
    assert {r["gid"] for r in QUERIES[name](spark, sf_dir).select("gid").distinct().collect()} == {r[0] for r in duck.execute(all_).fetchall()}


def test_flagship_gives_values(spark, sf_dir):
    assert QUERIES[FLAGSHIP](spark, sf_dir).where("windspeed_100m > 0").count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["south_north", "west_east", "t_block", "windspeed_100m"]
