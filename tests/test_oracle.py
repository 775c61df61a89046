"""Every catalogue query with SQL against DuckDB at the smallest scale."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from stockcast.plans.catalog import QUERIES
from stockcast.plans.oracle import ORACLES

NAMES = list(ORACLES)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v.date() if isinstance(v, datetime.datetime) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def test_every_query_has_sql_or_is_fitted():
    assert set(QUERIES) - set(ORACLES) == {"ets", "arima", "arima_plain", "arma", "gbt", "gbt_pooled", "gbt_rel", "gbt_rel_pooled", "gbt_poisson", "gbt_rel_recent", "gbt_quantiles", "daily_fitted", "weekly_fitted"}


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    found = table(df.columns, df.collect())
    r = con.execute(ORACLES[name])
    wanted = table([c[0] for c in r.description], r.fetchall())
    assert found[0] == wanted[0]
    assert len(found[1]) == len(wanted[1])
    for a, b in zip(found[1], wanted[1], strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6)), (a, b)
