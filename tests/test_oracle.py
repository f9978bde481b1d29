import os

import pytest

from trailbed.plans.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


def text(v):
    return "NULL" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(text(r[names.index(c)]) for c in cols) for r in cur.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
