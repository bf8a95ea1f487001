"""Registered queries next to their SQL. The longer ones are left to ``tests/compare.py``."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from chatledger import oracle
from chatledger.queries import REGISTERED
from tests.compare import connect, mismatch

SF = "/root/testdata/sf0.001"

QUICK = [
    "log_scan", "log_bounded_scan", "log_append", "log_export", "log_import", "import_validation",
    "import_rejects", "import_append", "decode_damaged", "unread_after_redelivery", "poison_events", "chats_for_user", "events_decode",
    "events_by_type", "events_unknown", "partition_balance", "events_ordered", "log_dedup", "chat_lifetimes",
    "chat_common", "adds_skipped", "chat_participant", "message_lifetimes", "message_versions", "message_table",
    "fanout_users", "messages_of_chat", "participants_all", "message_owner", "last_message_id", "chat_ids",
    "cmd_chat_pin", "assign_chat_ids", "message_id_high_water", "consumer_lag", "is_caught_up", "unread_view",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, con, name):
    assert mismatch(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


def test_every_query_has_sql():
    assert set(REGISTERED) == set(oracle.oracle_sql())


def test_entry_is_stable(spark):
    assert entry.entry(spark).columns[:3] == ["user_id", "pos", "id"]
