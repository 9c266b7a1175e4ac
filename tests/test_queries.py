"""Every registered query with an oracle against that oracle, on whole small tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from sievework.plans.queries import ORACLES, QUERIES
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows_of(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
            return "null"
        return repr(round(float(x), 6)) if isinstance(x, float) else str(list(x)) if hasattr(x, "tolist") and hasattr(x, "__len__") else str(x)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", ORACLES)
def test_against_the_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_queries_without_an_oracle_run(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
