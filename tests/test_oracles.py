"""Every named query runs; those with SQL agree with it."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

SF = "/root/testdata/sf0.01"
QUERIES, ORACLES = entry.QUERIES, entry.ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    got = entry.entry(spark)
    assert {"asset", "topic", "period_id", "cov"} <= set(got.columns) and got.count() > 0


def test_study_checks_pass(spark):
    rows = QUERIES["study_checks"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) > 12 and [r["name"] for r in rows if r["status"] == "fail"] == []
