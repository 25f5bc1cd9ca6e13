import duckdb
import pytest

from quern.llm import queries
from tests.test_queries import TABLES

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    a, b = queries.QUERIES[name](spark, D), con.sql(queries.ORACLES[name])
    assert sorted(a.columns) == sorted(b.columns)
    assert sorted(map(str, map(tuple, a.select(*b.columns).collect()))) == sorted(map(str, b.fetchall()))
