"""Queries that SQL can express against that SQL."""
import duckdb
import pytest

from conftest import SF
from tubelens.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    norm = lambda d: sorted(map(tuple, d[cols].astype(str).values.tolist()))
    assert norm(got) == norm(want)


def test_every_operator_has_a_query():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))
