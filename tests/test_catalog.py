"""A few registered queries against their SQL on the smallest tables, and the entry module's contract."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools_compare import norm

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "orders", "events"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["c06_polsby_popper", "d05_union_by_slabs", "e06_ladder", "f03_apartments", "g07_margins", "g19_cluster_intervals", "h04_buildings", "i09_fit_rung3"])
def test_query_matches_its_sql(spark, con, name):
    got, want = norm(entry.queries()[name](spark, SF).toPandas()), norm(con.execute(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and got.equals(want)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
