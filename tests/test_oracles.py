"""Every query against its SQL at sf0.001. A fixed part by default, all with CHECK_ALL=1."""
import math
import os

import duckdb
import pytest

from checks.oracles import SQL
from checks.queries import QUERIES
from conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUICK = "s3 g5_large s15 s15_stream g1_large p6 p9 p18 j1 j3 j4 j8 a2 a4 a9 a14 w6 w8 k1 k7 g2 g3 g5 e2 e7".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df):
    clean = lambda x: None if x is None or x != x else (round(float(x), 6) if isinstance(x, float) else x)
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(clean(x) for x in r) for r in df.where(df.notna(), None).itertuples(index=False)), key=str)


def test_keys_match():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(SQL) if os.environ.get("CHECK_ALL") else QUICK)
def test_query(spark, duck, key):
    got, want = QUERIES[key](spark, SF).toPandas(), duck.execute(SQL[key]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, abs_tol=2e-6))
                   for p, q in zip(x, y)), (x, y)
