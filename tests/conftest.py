"""Shared session for all tests."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.compare import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("chatledger-tests")
    yield session
    session.stop()


@pytest.fixture(params=["plain", "hot"])
def skew(request, spark):
    """Runs a test twice: once as is, once with every larger chat split into short spans."""
    if request.param == "hot":
        spark.conf.set("spark.chatledger.hotRows", "12")
        spark.conf.set("spark.chatledger.spanWidth", "37")
    yield request.param
    spark.conf.unset("spark.chatledger.hotRows")
    spark.conf.unset("spark.chatledger.spanWidth")
