"""Every registered query against its SQL twin (DuckDB) on the smallest data folder."""

import pytest

import __spark_entry__ as entry
from oracle_check import check, duck

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    res = check(spark, name, entry.queries()[name], entry.oracle_sql().get(name), SF, con)
    assert res["status"] in ("ok", "rows-only"), res


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "recall" in df.columns
