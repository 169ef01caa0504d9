"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from tallyhound.plans.catalogue import ORACLES, QUERIES
from tests.compare import compare, oracle_connection

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
HEAVY = {"au01_whole_audit", "ml10_review_queue", "ml06_permutation_importance", "r23_all_rules"}


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", [q for q in QUERIES if q in ORACLES])
def test_agrees_with_sql(spark, con, name):
    ok, told = compare(spark, con, SF, name)
    assert ok, told


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in ORACLES and q not in HEAVY])
def test_runs(spark, con, name):
    assert compare(spark, con, SF, name)[0]


def test_all_rules_run(spark):
    rules = {r["rule"] for r in QUERIES["r23_all_rules"](spark, SF).collect()}
    assert len(rules) > 35
