"""Registered queries against their SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from corpusloom.queries import load

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def clean(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, list | tuple):
        return [clean(x) for x in v]
    return v


@pytest.mark.parametrize("name", sorted(n for n, q in load().items() if q.sql))
def test_matches_sql(spark, duck, name):
    q = load()[name]
    df = q.run(spark, FOLDER)
    cur = duck.execute(q.sql)
    theirs = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(theirs)
    ours = sorted(repr([clean(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    assert ours == sorted(repr([clean(r[theirs.index(c)]) for c in sorted(theirs)]) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(n for n, q in load().items() if not q.sql))
def test_runs(spark, name):
    assert load()[name].run(spark, FOLDER).count() >= 0
