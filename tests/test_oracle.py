"""Every query with SQL must return what its SQL returns. TEST_ALL=1 runs all of them."""

import os

import oracle
import pytest

from tarmac.plans import catalogue

QUICK = ["traffic_flow", "traffic_by_direction", "motion_features", "rule_violations", "trigger_cooldown",
         "recording_episodes", "nearest_cameras", "risk_labels", "blink_score", "keyword_search",
         "threshold_search", "upsert_latest", "traffic_stream", "episode_stream"]
NAMES = sorted(catalogue.SQL) if os.environ.get("TEST_ALL") else QUICK


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, small, con, name):
    _, problems = oracle.compare(spark, con, small, catalogue.QUERIES[name], catalogue.SQL[name])
    assert not problems


def test_every_query_has_a_home():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
    assert len(catalogue.QUERIES) > 95
