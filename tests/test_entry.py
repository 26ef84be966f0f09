"""The registered queries of the graph operators against DuckDB on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
#: Some minutes of small jobs; tests/test_joins.py holds what they run against brute force.
LONG = {"bridging_ring_by_joins", "bridging_forest_by_joins", "keyplayer_greedy_by_joins", "keyplayer_stochastic_by_joins"}


def test_entry_and_oracles(spark):
    import duckdb

    import __spark_entry__ as e
    from netmetrics.plans.queries import oracle_sql, queries

    if not os.path.isdir(SF):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert e.entry(spark).count() == 15
    assert set(oracle_sql()) <= set(queries()) <= set(e.queries())
    for name, sql in oracle_sql().items():
        if name in LONG:
            continue
        df = queries()[name](spark, SF)
        cols = sorted(df.columns)
        got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
        r = con.execute(sql)
        names = [d[0] for d in r.description]
        want = sorted((tuple(dict(zip(names, x, strict=True))[c] for c in cols) for x in r.fetchall()), key=repr)
        assert sorted(names) == cols and got == want, name
