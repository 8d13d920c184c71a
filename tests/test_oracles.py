"""Every registered query against its SQL counterpart on the benchmark tables."""

from __future__ import annotations

import pytest
from paths import SF_DIR

import __spark_entry__
from tools.check_oracles import compare, connect
from txrisk.plans.registry import QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], SF_DIR) is None


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_registry_is_consistent():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
