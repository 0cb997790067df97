"""Every query with SQL gives the same rows as the SQL does, on the smallest corpus."""

import os
from collections import Counter

import pytest

from clausewright.plans import all_queries, all_sql
from clausewright.sources.tables import TABLES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return round(x, 5)
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    df = all_queries()[name](spark, DATA)
    ours = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name in all_sql():
        cur = con.execute(all_sql()[name])
        cols = [x[0] for x in cur.description]
        theirs = Counter(tuple(plain(dict(zip(cols, r))[c]) for c in sorted(cols)) for r in cur.fetchall())
        assert sorted(cols) == sorted(df.columns) and ours == theirs
