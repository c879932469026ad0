"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from lumenvec.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(rows):
    key = lambda t: tuple((v is None, str(v)) for v in t)
    return sorted((tuple(0.0 if isinstance(v, float) and v == 0 else v for v in r) for r in rows), key=key)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, sql, name):
    frame = registry.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    found = sql.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert plain(map(tuple, frame.select(*columns).collect())) == plain(tuple(r[i] for i in order) for r in found.fetchall())


def test_fractions_of_seconds_round_as_in_sql(spark, tmp_path):
    """A day after 0.4 s lies 86,399.7 to 86,400.6 s later: which second a fraction goes to decides the interval."""
    later = (86399.7, 86400.1, 86400.5, 86400.9, 86401.5, 172799.9, 172801.5)
    con = duckdb.connect()
    rows = ", ".join(f"({u * 10 + i}, {u}, TIMESTAMP '2024-01-01' + to_microseconds({round(t * 1_000_000)}))" for u, first in enumerate((0.4, 0.5, 0.6, 1.5)) for i, t in enumerate((first, *later)))
    con.execute(f"CREATE TABLE events AS SELECT * FROM (VALUES {rows}) t(event_id, user_id, ts)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    frame = registry.QUERIES["snapshot_schedule"](spark, str(tmp_path))
    assert plain(map(tuple, frame.collect())) == plain(con.execute(registry.ORACLES["snapshot_schedule"]).fetchall())
