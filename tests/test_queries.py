"""Every registered query runs at the smallest scale; those with SQL agree with it."""

import re

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF = "/root/testdata/sf0.001"
CORPUS = re.compile(r"op\d+_|pipeline$")  # these have tests of their own
QUERIES = {k: v for k, v in entry.queries().items() if not CORPUS.match(k)}
ORACLES = {k: v for k, v in entry.oracle_sql().items() if k in QUERIES}
HEAVY = {
    "model_forecast", "model_report", "reason_contributions", "exact_reason_contributions", "served_forecast", "submission", "feature_importance",
    "outage_scorecard", "point_features", "point_features_gps_hint", "bootstrap_interval",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    _, _, problems = compare(spark, con, QUERIES[name], ORACLES[name], SF)
    assert not problems


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - HEAVY))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
