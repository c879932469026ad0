"""The operators' queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from lumenvec.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    frame = queries.QUERIES[name](spark, DATA)
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    key = lambda t: tuple((v is None, str(v)) for v in t)
    assert sorted(map(tuple, frame.select(*names).collect()), key=key) == sorted(found.fetchall(), key=key)
