"""Every query of the library against its SQL in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from ledgerloom.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    got = sorted((tuple(plain(r[i]) for i in order) for r in df.collect()), key=repr)
    found = duck.execute(SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
