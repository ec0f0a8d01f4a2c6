"""Every query with SQL against DuckDB on the driver's small tables."""

import os

import duckdb
import pytest

from weftline.plans import registry
from weftline.sources.tables import TABLES

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame)]
    return sorted(str(tuple(float(x) if isinstance(x, (int, float)) else x for x in r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    mine, other = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(mine) == sorted(other)
    assert len(mine) and rows(mine) == rows(other)
