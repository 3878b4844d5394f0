import math

import duckdb
import pytest

from faultweave.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def norm(v):
    return "null" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(float(v) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    query, sql = QUERIES[name]
    df = query(spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if sql is None:
        assert got
        return
    rel = duck.sql(sql)
    names = rel.columns
    assert sorted(names) == cols
    assert got == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall())
