"""Random logs, with events in any order, against the sequential rules."""

from __future__ import annotations

import random

import pytest

from chatledger import schemas as S
from chatledger.operators import history as H
from chatledger.operators import projections as P
from chatledger.operators import unread as U
from chatledger.plans.materialize import cut_lineage
from chatledger.plans.skew import flag_hot
from tests.fold import event, frame, refresh, replay

USERS = range(4)


def random_log(seed: int, chats: int = 60, length: int = 60) -> list[dict]:
    """Interleaved logs of many chats: repeated creates, reused ids, id 0, deletes of what is not there,
    users listed twice, null lists, and times that run backwards. Deletes mostly hit the newest message, so
    markers jump often and in chains."""
    rnd = random.Random(seed)
    rows, newest = [], {}

    def users() -> list[int] | None:
        return rnd.choice([list(USERS), rnd.choices(USERS, k=rnd.randint(0, 4)), None])

    for seq in range(chats * length):
        chat = rnd.randrange(chats)
        minute, roll = rnd.randrange(1000), rnd.random()
        some = newest.get(chat, 0) - rnd.choice([0, 0, 0, 1, 2, 3])
        make = lambda name, **f: rows.append(event(seq, chat, name, minute=minute, **f))
        if roll < 0.05:
            make(S.CHAT_CREATED, title=f"c{seq}")
        elif roll < 0.08:
            make(S.CHAT_EDITED, title=f"e{seq}")
        elif roll < 0.10:
            make(S.CHAT_DELETED)
        elif roll < 0.20:
            make(S.PARTICIPANTS_ADDED, participant_ids=users())
        elif roll < 0.24:
            make(S.PARTICIPANT_DELETED, participant_ids=users())
        elif roll < 0.28:
            make(S.CHAT_PINNED, participant_id=rnd.choice(USERS), pinned=rnd.random() < 0.6)
        elif roll < 0.46:
            fresh = newest.get(chat, -1) + 1 if rnd.random() < 0.8 else rnd.randint(0, 5)
            newest[chat] = max(newest.get(chat, 0), fresh)
            make(S.MESSAGE_CREATED, message_id=fresh, owner_id=rnd.choice(USERS), content=f"m{seq}")
        elif roll < 0.51:
            make(S.MESSAGE_EDITED, message_id=max(0, some), content=f"x{seq}")
        elif roll < 0.63:
            make(S.MESSAGE_DELETED, message_id=max(0, some))
        elif roll < 0.73:
            make(S.MESSAGE_READED, participant_id=rnd.choice(USERS), message_id=max(0, some + rnd.randint(0, 1)))
        else:
            rows.append(refresh(
                seq, chat, users(), unread=rnd.choice([0, 1, 1, 2]), message=rnd.choice([0, 1]),
                common=rnd.choice([0, 0, 1]), title=f"r{seq}", owner_id=rnd.choice(USERS),
                increase_on=rnd.randint(1, 3), minute=minute,
            ))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_tables_equal_sequential_replay(spark, skew, seed):
    rows = random_log(seed)
    expected = replay(rows).tables()
    events = cut_lineage(flag_hot(frame(spark, rows)))
    assert events.where("hot").isEmpty() == (skew == "plain")
    lives = cut_lineage(H.message_lives(events))
    actual = {
        "chat_common": P.chat_common(events).drop("last_generated_message_id"),
        "members": P.members(events),
        "messages": P.messages(events),
        "view": P.user_view(events, lives),
        "unread": U.unread(events, lives),
    }
    for name, table in actual.items():
        got = [tuple(r) for r in table.collect()]
        assert len(got) == len(set(got)), name
        assert set(got) == expected[name], name


def test_marker_history_equals_sequential_replay(spark, skew):
    rows = random_log(3)
    changes: dict = {}
    for key, seq, marker in replay(rows).marker_log:
        changes.setdefault(key, []).append((seq, marker))
    events = cut_lineage(flag_hot(frame(spark, rows)))
    history: dict = {}
    for r in U.marker_history(events).collect():
        history.setdefault((r.user_id, r.chat_id), []).append((r.log_seq, r.value))
    # The library also lists certain operations that leave the marker as it was.
    condensed = {}
    for key, steps in history.items():
        out = []
        for seq, value in sorted(steps):
            if not out or out[-1][1] != value:
                out.append((seq, value))
        condensed[key] = out
    assert condensed == changes


def test_long_chain_of_jumps(spark, skew):
    """A moderator deletes from the newest down: a marker that follows jumps once per deletion."""
    rows, seq = [event(0, 1, S.CHAT_CREATED, title="t"), event(1, 1, S.PARTICIPANTS_ADDED, participant_ids=[1, 2])], 2
    for i in range(1, 41):
        rows.append(event(seq, 1, S.MESSAGE_CREATED, message_id=i, owner_id=1, content=f"m{i}"))
        seq += 1
    rows.append(event(seq, 1, S.MESSAGE_READED, participant_id=2, message_id=40))
    for i in range(40, 3, -1):
        rows.append(event(seq + 1, 1, S.MESSAGE_DELETED, message_id=i))
        rows.append(refresh(seq + 2, 1, [1, 2], unread=1))
        seq += 2
    events = cut_lineage(flag_hot(frame(spark, rows)))
    assert {tuple(r) for r in U.unread(events).collect()} == replay(rows).tables()["unread"] == {
        (1, 1, 3, 0), (2, 1, 0, 3)
    }


def test_lookups_against_brute_force(spark, skew):
    """Newest id, existence, counts and members as of any position, by looking at all rows."""
    rows = random_log(4, chats=6, length=80)
    events = cut_lineage(flag_hot(frame(spark, rows)))
    lives = cut_lineage(H.message_lives(events))
    spans = lives.collect()
    hot = {r.chat_id: r.hot for r in events.select("chat_id", "hot").distinct().collect()}
    alive = lambda c, t: [s.id for s in spans if s.chat_id == c and s.from_seq <= t < s.to_seq]
    asked = [(c, t, m, hot[c]) for c in range(6) for t in range(0, 480, 7) for m in (0, 2, 5)]
    marks = spark.createDataFrame(asked, "chat_id bigint, at bigint, marker bigint, hot boolean")
    counted = {(r.chat_id, r.at, r.marker): r.n for r in H.count_after(marks, lives).collect()}
    assert counted == {(c, t, m): sum(i > m for i in alive(c, t)) for c, t, m, _ in asked}
    newest = {(r.chat_id, r.at): r.newest for r in H.newest_at(marks, lives).collect()}
    assert newest == {(c, t): max(alive(c, t), default=None) for c, t, _, _ in asked}
    keys = marks.withColumnRenamed("marker", "id")
    found = {(r.chat_id, r.at, r.id): r.exists for r in H.existing_at(keys, lives).collect()}
    assert found == {(c, t, m): m in alive(c, t) for c, t, m, _ in asked}
    members = H.member_intervals(events)
    stays = members.collect()
    present = {tuple(r) for r in H.members_at(marks, members).collect()}
    assert present == {
        (c, t, s.user_id) for c, t, _, _ in asked for s in stays if s.chat_id == c and s.from_seq <= t < s.to_seq
    }


def test_counts_above_negative_markers(spark):
    draw = random.Random(3)
    lives = [(1, draw.randint(-5, 5), a, a + draw.randint(1, 9), False) for a in range(0, 60, 10) for _ in range(2)]
    lives = list({(c, i, a): (c, i, a, b, h) for c, i, a, b, h in lives}.values())
    marks = [(1, at, m, False) for at in range(0, 60, 7) for m in range(-6, 7, 3)]
    got = H.count_after(
        spark.createDataFrame(marks, "chat_id long, at long, marker long, hot boolean"),
        spark.createDataFrame(lives, "chat_id long, id long, from_seq long, to_seq long, hot boolean")).collect()
    assert {(r.at, r.marker): r.n for r in got} == {
        (at, m): sum(i > m and a <= at < b for _, i, a, b, _ in lives) for _, at, m, _ in marks}
