"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_mod
from surfacewx.plans.oracle import ORACLE
from surfacewx.plans.registry import QUERIES
from surfacewx.schema import REPORT_FIELDS

TABLES = ["supplier", "events", "lineitem", "orders"]


def _norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _bag(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(entry_mod.queries()) and set(entry_mod.oracle_sql()) <= set(entry_mod.queries())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, sf_small, key):
    df = QUERIES[key](spark, sf_small)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLE[key])
    orows = cur.fetchall()
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _bag(srows, df.columns) == _bag(orows, ocols)


def test_entry_flagship(spark):
    if not os.path.exists(entry_mod.SMOKE_DIR):
        pytest.skip("no smoke tables")
    df = entry_mod.entry(spark)
    assert df.columns == REPORT_FIELDS
    assert df.count() == 11


@pytest.mark.parametrize("sf,n,mean,std,outliers", [("0.001", 744, 49.94838709677417, 46.413801175098264, 11), ("0.01", 7492, 50.1920982381205, 49.80648753997859, 143)])
def test_golden_statistics(spark, sf, n, mean, std, outliers):
    d = f"/root/testdata/sf{sf}"
    if not os.path.exists(d):
        pytest.skip("no tables")
    from surfacewx.plans.detect import detect_stats
    from surfacewx.plans.registry import _obs, _stations, flagship_outliers

    s = detect_stats(_obs(spark, d), _stations(spark, d), obs_key="k", station_key="s_suppkey").first()
    assert s.n == n
    assert s.mean == pytest.approx(mean, rel=1e-12)
    assert s.stddev == pytest.approx(std, rel=1e-12)
    assert flagship_outliers(spark, d).count() == outliers
