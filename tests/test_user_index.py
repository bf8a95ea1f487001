"""The index from users to chats, and lists read through it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chatledger.operators import projections as P
from chatledger.operators import reads as R
from chatledger.operators import unread as U
from chatledger import queries
from chatledger.queries import store
from chatledger.sources import user_index as X
from chatledger.sources.tables import store_events
from tests.fold import frame
from tests.test_random_logs import random_log

SF = "/root/testdata/sf0.001"


def listed(events, user):
    rows = R.chats_for_user(P.user_view(events), U.unread(events), user)
    return [tuple(r) for r in rows.select(*R.LIST_COLUMNS).collect()]


@pytest.mark.parametrize("most", [0, 2_000])
def test_list_equals_whole_fold(spark, most):
    """By list of ids and by join; a user that no event names has no events."""
    events = store_events(frame(spark, random_log(5, chats=6, length=30)))
    index = X.write_user_index(events)
    user = index.agg(F.max("user_id")).first()[0]
    assert X.events_for_user(events, index, 10**12, most=most).isEmpty()
    own = X.events_for_user(events, index, user, most=most)
    assert listed(own, user) == listed(events, user)


def test_ids_reach_the_scan(spark):
    events = store(spark, SF).events
    index = X.write_user_index(events)
    user = index.agg(F.min("user_id")).first()[0]
    plan = spark._jvm.PythonSQLUtils.explainString(
        X.events_for_user(events, index, user)._jdf.queryExecution(), "formatted")
    pushed = [line for line in plan.splitlines() if line.startswith("PushedFilters")]
    assert pushed and all("chat_id" in line for line in pushed)
    plan = spark._jvm.PythonSQLUtils.explainString(X.chats_of(index, user)._jdf.queryExecution(), "formatted")
    assert f"EqualTo(user_id,{user})" in plan


def test_extended_index_equals_whole(spark, tmp_path):
    log = frame(spark, random_log(8, chats=20, length=40)).cache()
    middle = log.agg(F.expr("max(log_seq) div 2")).first()[0]
    path = f"{tmp_path}/index"
    X.write_user_index(log.where(F.col("log_seq") <= middle), path)
    both = X.extend_user_index(log.where(F.col("log_seq") > middle), path)
    again = X.extend_user_index(log, path)
    whole = sorted(tuple(r) for r in X.write_user_index(log).collect())
    assert sorted(tuple(r) for r in both.collect()) == sorted(tuple(r) for r in again.collect()) == whole


def test_empty_and_null(spark):
    rows = frame(spark, random_log(3, chats=2, length=20))
    assert X.write_user_index(rows.limit(0)).count() == 0
    odd = rows.limit(1).withColumns({
        "name": F.lit("participantsAdded"), "participant_ids": F.expr("array(null, 4L, 4L)"), "chat_id": F.lit(2).cast("long")})
    assert [tuple(r) for r in X.write_user_index(odd).collect()] == [(4, 2)]


def test_list_of_first_user_folds_own_chats(spark, monkeypatch):
    """The query's folds see the histories of the first user's chats and no others, with the list of the whole fold."""
    events = store_events(frame(spark, random_log(11, chats=8, length=30)))
    monkeypatch.setattr(queries, "_events", lambda *_: events)
    monkeypatch.setattr(queries, "_per_chat", lambda _, __, fold: fold(events))
    user = P.user_view(events).agg(F.min("user_id")).first()[0]
    seen = []

    def view(rows, lives):
        seen.extend(r.chat_id for r in rows.select("chat_id").distinct().collect())
        return user_view(rows, lives)

    user_view = P.user_view
    monkeypatch.setattr(P, "user_view", view)
    got = queries.chats_for_user(spark, SF).orderBy("pos").collect()
    assert [tuple(r)[2:] for r in got] == listed_by(user_view, events, user) and {r.user_id for r in got} == {user}
    own = {r.chat_id for r in P.members(events).where(F.col("user_id") == user).collect()}
    assert set(seen) == own and len(own) < events.select("chat_id").distinct().count()


def listed_by(user_view, events, user):
    rows = R.chats_for_user(user_view(events), U.unread(events), user)
    return [tuple(r) for r in rows.select(*R.LIST_COLUMNS).collect()]


def test_list_of_nobody(spark, monkeypatch):
    events = store_events(frame(spark, random_log(11, chats=2, length=20)).where("name = 'messageCreated'"))
    monkeypatch.setattr(queries, "_events", lambda *_: events)
    monkeypatch.setattr(queries, "_per_chat", lambda _, __, fold: fold(events))
    assert queries.chats_for_user(spark, SF).isEmpty()
