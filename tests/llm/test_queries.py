"""The queries of the training-data operators on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from kiln.llm import queries as Q  # noqa: E402

COLUMNS = {
    "p2_found": ["block_id", "block_kind"], "p4_found": ["item_id"], "p5_found": ["record_kind", "record_key", "noise", "fragment"], "p6_found": ["question_id", "defect"], "p7_found": ["record_kind", "record_key"], "p8_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "category"],
}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_runs(spark, sf, name):
    df = Q.queries()[name](spark, sf)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(set(rows)) == len(rows)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    r = con.execute(Q.oracle_sql()[name])
    cols = [d[0] for d in r.description]
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted((tuple(norm(x) for x in row) for row in r.fetchall()), key=str)
    assert sorted((tuple(norm(x[c]) for c in cols) for x in Q.queries()[name](spark, sf).collect()), key=str) == want
