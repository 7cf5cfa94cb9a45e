"""Every core query against its SQL on the smallest tables; the keys of both cannot drift."""

import math
import os

import pytest

from kiln.plans import registry

duckdb = pytest.importorskip("duckdb")


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(canon, v))
    return v if isinstance(v, int) else str(v)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, sf, con, name):
    df = registry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    r = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    key = lambda row: tuple((x is None, str(x)) for x in row)
    want = sorted((tuple(canon(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=key)
    assert sorted((tuple(canon(x[c]) for c in cols) for x in df.collect()), key=key) == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf, name):
    df = registry.queries()[name](spark, sf)
    assert df.columns and df.count() >= 0
