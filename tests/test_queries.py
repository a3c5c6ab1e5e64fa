"""Every query against its SQL, and rules for all plans."""

import pytest
from compare import difference, oracle

import __spark_entry__ as entry
from conftest import plan
from fleetlens.plans import bindings, oracles

SF = "/root/testdata/sf0.001"
QUERIES, SQL = bindings.JOBS, oracles.SQL
SINKS = {"panel_report_write", "records_to_csv"}
HEAVY = {"health_check_panels", "panel_report_write"}


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_building_a_query_starts_no_job(spark):
    for name, query in QUERIES.items():
        if name not in SINKS:
            query(spark, SF)  # the schemas of the tables are read once
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "building only")
    for name, query in QUERIES.items():
        if name not in SINKS:
            query(spark, SF)
    started = tracker.getJobIdsForGroup("build")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(started) == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    found, n = difference(spark, SF, con, QUERIES[name], SQL[name])
    assert found is None
    assert n > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - HEAVY))
def test_plans(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for word in ("NestedLoop", "Cartesian", "Python", "Pandas"):
        assert word not in text


@pytest.mark.parametrize("name", sorted(set(QUERIES) - HEAVY))
def test_queries_without_broadcast(spark, con, no_broadcast, name):
    found, _ = difference(spark, SF, con, QUERIES[name], SQL[name])
    assert found is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["machine", "panel_no", "panel", "kind", "series", "x", "y"]
    assert df.limit(1).count() == 1
