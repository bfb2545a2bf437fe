"""Every query with SQL gives the rows that DuckDB gives; the others run and have rows."""

import math
import os

import duckdb
import pytest

from gaitwright.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{sf_dir}/{name}')")
    return con


def rows_of(frame):
    return sorted((tuple(None if v is None or (isinstance(v, float) and math.isnan(v)) else v for v in r) for r in frame), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = rows_of(df.select(*columns).collect())
    if name not in ORACLES:
        assert got
        return
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = duck.execute(f"select {quoted} from ({ORACLES[name]})").fetchall()
    assert len(got) == len(want)
    for a, b in zip(got, rows_of(want)):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and y is not None and math.isclose(x, float(y), rel_tol=1e-9, abs_tol=1e-7)), (a, b)
