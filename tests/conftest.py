from __future__ import annotations

import os
import sys

import pytest

_HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(_HERE), _HERE]

from txrisk.session import (  # noqa: E402
    DEFAULT_MAX_BROADCAST_BYTES,
    DEFAULT_MAX_GROUP_ROWS,
    MAX_BROADCAST_BYTES_CONF,
    MAX_GROUP_ROWS_CONF,
    local_session,
)

@pytest.fixture(scope="session")
def spark():
    session = local_session("4", memory="4g", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def settings(spark):
    """Change session settings for one test."""
    changed = []

    def change(name, value):
        changed.append(name)
        spark.conf.set(name, str(value))

    yield change
    for name in changed:
        spark.conf.unset(name)


@pytest.fixture
def small_groups(settings):
    """Groups above 20 rows count as hot, so every order-dependent operator splits them."""
    settings(MAX_GROUP_ROWS_CONF, 20)


__all__ = ["DEFAULT_MAX_BROADCAST_BYTES", "DEFAULT_MAX_GROUP_ROWS", "MAX_BROADCAST_BYTES_CONF"]
