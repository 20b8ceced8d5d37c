"""Every catalogue query with an oracle gives the oracle's rows."""

import duckdb
import pandas as pd
import pytest

from stratum.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents".split()
ORACLES = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(df):
    def cell(v):
        if pd.isna(v):
            return "null"
        return f"{v:.6g}" if isinstance(v, float) else str(v).replace(" 00:00:00", "")

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, sf, duck, name):
    got = catalogue.queries()[name](spark, sf).toPandas()
    want = duck.sql(ORACLES[name]).df()
    assert set(got.columns) == set(want.columns)
    assert plain(got) == plain(want)
