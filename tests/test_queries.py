"""Every registered query with SQL of its own gives the oracle's rows on the smallest tables."""

import math

import duckdb
import pytest

from rankweave.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events pages labels".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    def told(v):
        if v is None or isinstance(v, float) and math.isnan(v) or type(v).__name__ in ("NaTType", "NAType"):
            return "-"
        if isinstance(v, (bool, str)) or type(v).__name__ == "bool_":
            return str(v)
        if hasattr(v, "year"):
            return str(v)[:19].removesuffix(" 00:00:00")
        return f"{float(v):.5f}".replace("-0.00000", "0.00000")

    df = df[sorted(df.columns)]
    return sorted(tuple(told(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
