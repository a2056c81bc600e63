"""The registered queries: their names, and those with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_names():
    names = [n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(n.split("_")[0] for n in names) == sorted([*(f"op{k}" for k in range(1, 11)), "pipeline"])


@pytest.mark.parametrize("number", [1, 5, 6, 7, 9])
def test_queries_with_sql(spark, number):
    (name,) = (n for n in __spark_entry__.queries() if n.startswith(f"op{number}_"))
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    ours = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(ours.columns)
    theirs = con.execute(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, ours.select(*columns).collect()))) == sorted(map(repr, theirs))
