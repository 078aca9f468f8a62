"""The queries that have SQL against DuckDB, whole tables."""

import os

import duckdb
import pytest

from gridloom.llm.oracles import ORACLES
from gridloom.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for table in os.listdir(sf_dir):
        con.execute(f"create view {table.removesuffix('.parquet')} as select * from '{sf_dir}/{table}'")
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = con.execute(f"select {', '.join(columns)} from ({ORACLES[name]}) q").fetchall()
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, want))


def test_all_are_registered():
    assert [f"op{n}" for n in range(1, 14)] == [k.partition("_")[0] for k in QUERIES]
