"""Command batches against a log."""

from __future__ import annotations

import pytest

from chatledger import schemas as S
from chatledger.functions.text import to_flag, to_id
from chatledger.operators import commands as C
from chatledger.operators.history import member_intervals
from chatledger.operators.ids import assign_ids, message_id_high_water
from chatledger.plans.materialize import cut_lineage
from chatledger.plans.skew import flag_hot
from pyspark.sql import functions as F
from tests.fold import START, event, frame, replay
from tests.test_random_logs import random_log

COMMAND = """cmd_seq bigint, kind string, user_text string, chat_text string, message_text string, title string,
    content string, pin_text string, participant_ids array<bigint>, created_at timestamp_ntz"""


def command(seq: int, kind: str, user="1", chat="1", message=None, **more) -> tuple:
    given = {"title": None, "content": None, "pin_text": None, "participant_ids": None, **more}
    return (seq, kind, user, chat, message, *given.values(), START)


def log() -> list[dict]:
    """Chat 1 with users 1 and 2; message 1 is of user 1, message 2 of user 2; user 2 has read message 1."""
    return [
        event(0, 1, S.CHAT_CREATED, title="t"), event(1, 1, S.PARTICIPANTS_ADDED, participant_ids=[2, 1]),
        event(2, 1, S.MESSAGE_CREATED, message_id=1, owner_id=1, content="a"),
        event(3, 1, S.MESSAGE_READED, participant_id=2, message_id=1),
        event(4, 1, S.MESSAGE_CREATED, message_id=2, owner_id=2, content="b"),
        event(20, 1, S.CHAT_DELETED), event(21, 1, S.PARTICIPANT_DELETED, participant_ids=[1, 2]),
    ]


BATCH = [
    command(10, "chat_create", chat=None, title="n", participant_ids=[5, 1]),
    command(11, "chat_create", chat=None, user="9", title="o", participant_ids=[5]),
    command(12, "chat_edit", title="e", participant_ids=[7]),
    command(13, "chat_edit", title="f", participant_ids=[]),
    command(14, "participant_add", participant_ids=[8, 8]),
    command(15, "chat_pin", pin_text="True"), command(16, "chat_pin", pin_text="yes"),
    command(17, "message_create", content="c"),
    command(18, "message_edit", message="1", content="d"),          # own, not the newest
    command(19, "message_edit", user="2", message="2", content="d"),  # own, the newest
    command(20, "message_delete", user="2", message="1"),           # not the owner
    command(20, "message_delete", user="2", message="7"),           # no such message
    command(20, "message_delete", message="1"),
    command(19, "message_read", user="2", message="99"), command(19, "message_read", user="2", message="1"),
    command(19, "message_read", user="1", message="0"), command(19, "message_read", user="3", message="1"),
    command(20, "chat_delete"),
    command(30, "message_create", content="late"),
    command(31, "chat_pin", chat=" 1"), command(32, "message_edit", message="1x"), command(33, "chat_pin", user=None),
]


def test_expansion(spark, skew):
    # Positions repeat here, so verdicts are told apart by kind and ids as well.
    batch = spark.createDataFrame([(i, *c[1:]) for i, c in enumerate(BATCH)], COMMAND)
    places = {i: c[0] for i, c in enumerate(BATCH)}
    shift = 100
    rows = [dict(r, log_seq=r["log_seq"] * shift) for r in log()]
    batch = batch.withColumn("cmd_seq", F.create_map(
        *[F.lit(x) for i, p in places.items() for x in (i, p * shift - len(BATCH) + i)])[F.col("cmd_seq")])
    back = {p * shift - len(BATCH) + i: i for i, p in places.items()}
    events, refused = C.expand_commands(batch, flag_hot(frame(spark, rows)))
    got: dict = {}
    for r in events.orderBy("cmd_seq", "slot", "page").collect():
        ids = None if r.participant_ids is None else list(r.participant_ids)
        got.setdefault(back[r.cmd_seq], []).append((r.name, r.chat_id, ids))
    reasons = {back[r.cmd_seq]: r.reason for r in refused.collect()}
    both, refreshed = [1, 2], S.CHAT_VIEW_REFRESHED
    assert got == {
        0: [(S.CHAT_CREATED, 2, None), (S.PARTICIPANTS_ADDED, 2, [5, 1])],
        1: [(S.CHAT_CREATED, 3, None), (S.PARTICIPANTS_ADDED, 3, [5, 9])],
        2: [(S.CHAT_EDITED, 1, None), (S.PARTICIPANTS_ADDED, 1, [7]), (refreshed, 1, both)],
        3: [(S.CHAT_EDITED, 1, None), (refreshed, 1, both)],
        4: [(S.PARTICIPANTS_ADDED, 1, [8, 8])],
        5: [(S.CHAT_PINNED, 1, None)], 6: [(S.CHAT_PINNED, 1, None)],
        7: [(S.MESSAGE_CREATED, 1, None), (refreshed, 1, both)],
        8: [(S.MESSAGE_EDITED, 1, None)],
        9: [(S.MESSAGE_EDITED, 1, None), (refreshed, 1, both)],
        12: [(S.MESSAGE_DELETED, 1, None), (refreshed, 1, both)],
        13: [(S.MESSAGE_READED, 1, None)],
        15: [(S.MESSAGE_READED, 1, None)],
        17: [(S.CHAT_DELETED, 1, None), (S.PARTICIPANT_DELETED, 1, both)],
    }
    assert reasons == {
        10: C.NOT_OWNER, 11: C.NO_MESSAGE, 16: C.NO_STATE, 18: C.NO_CHAT, 19: C.BAD_ID, 20: C.BAD_ID, 21: C.BAD_ID,
    }
    by_name = {(back[r.cmd_seq], r.name): r for r in events.collect()}
    assert by_name[7, S.MESSAGE_CREATED].message_id == 3 and by_name[7, refreshed].owner_id == 1
    assert by_name[13, S.MESSAGE_READED].message_id == 2  # clamped to the newest
    assert by_name[5, S.CHAT_PINNED].pinned is True and by_name[6, S.CHAT_PINNED].pinned is False


def test_long_member_lists_come_in_pages(spark):
    rows = [event(0, 1, S.CHAT_CREATED, title="t"), event(1, 1, S.PARTICIPANTS_ADDED, participant_ids=list(range(500))),
            event(7, 1, S.PARTICIPANT_DELETED, participant_ids=[3])]
    positions = spark.createDataFrame(
        [(1, 5, False), (1, 6, False), (1, 9, False), (2, 5, False)], "chat_id bigint, at bigint, hot boolean")
    pages = C.member_pages(positions, member_intervals(flag_hot(frame(spark, rows))), page=50).collect()
    for at, members in ((5, range(500)), (6, range(500)), (9, [u for u in range(500) if u != 3])):
        own = sorted((p.page, p.members) for p in pages if p.chat_id == 1 and p.at == at)
        assert [p for p, _ in own] == list(range(10)) and [u for _, m in own for u in m] == list(members)
    assert [(p.page, p.members) for p in pages if p.chat_id == 2] == [(0, [])]


def test_pages_do_not_change_the_replay(spark):
    """Three members to an event, or all of them: the same tables after every kind of command that lists members."""
    base = log()[:5] + [event(5, 1, S.PARTICIPANTS_ADDED, participant_ids=[3, 4, 5, 6, 7])]
    batch = spark.createDataFrame([
        command(100, "message_create", content="new"), command(101, "chat_edit", title="e", participant_ids=[]),
        command(102, "message_edit", user="2", message="2", content="d"), command(103, "message_delete", message="1"),
        command(104, "chat_delete"),
    ], COMMAND)
    states = []
    for page in (3, 1000):
        events = flag_hot(frame(spark, base))
        expanded, _ = C.expand_commands(batch, events, page)
        numbered = C.number_events(expanded, events).orderBy("log_seq").collect()
        state = replay(base + [dict(r.asDict(), partition=1, offset=0) for r in numbered])
        states.append((len(numbered), vars(state)))
    assert states[0][0] > states[1][0]
    a, b = ({k: v for k, v in s.items() if k != "marker_log"} for _, s in states)
    assert a == b


def test_posts_of_one_batch_get_ids_of_their_own(spark, skew):
    batch = spark.createDataFrame(
        [command(s, "message_create", chat=c, content=f"m{s}") for s, c in ((5, "1"), (6, "1"), (7, "9"), (8, "1"), (30, "1"))],
        COMMAND)
    rows = log()[:5] + [event(10, 1, S.MESSAGE_CREATED, message_id=40, owner_id=1, content="z")]
    events, refused = C.expand_commands(batch, flag_hot(frame(spark, rows)))
    made = {r.cmd_seq: r.message_id for r in events.where("slot = 0").collect()}
    assert made == {5: 3, 6: 4, 8: 5, 30: 41} and [r.cmd_seq for r in refused.collect()] == [7]


def test_many_steps_are_numbered_densely(spark):
    rows = log()[:5]
    for step in range(10):
        events = flag_hot(frame(spark, rows))
        batch = spark.createDataFrame([command(1000 + step, "chat_pin", pin_text="true"),
                                       command(1001 + step, "participant_add", participant_ids=[step])], COMMAND)
        parts = C.pin_chats(C.parse(batch.where("kind = 'chat_pin'"), events)[0]).unionByName(
            C.change_participants(C.parse(batch.where("kind <> 'chat_pin'"), events)[0]))
        made = C.number_events(parts, events).orderBy("log_seq").collect()
        rows += [dict(r.asDict(), partition=1, offset=0) for r in made]
    assert [r["log_seq"] for r in rows] == list(range(25))


def test_reads_are_admitted_as_the_rules_say(spark, skew):
    """Every user tries to read every message at many positions of random logs."""
    rows = random_log(5, chats=4, length=70)
    events = cut_lineage(flag_hot(frame(spark, rows)))
    expected, batch = {}, []
    for i, position in enumerate(range(1, 280, 9)):
        state = replay([r for r in rows if r["log_seq"] < position])
        for chat in range(4):
            user, given, seq = i % 4, i % 7, position
            top = max(state.ids(chat), default=None)
            row = state.unread.get((user, chat))
            if row is None or top is None:
                verdict = C.ERROR
            else:
                moves = min(given, top) > row[1] if row[1] in state.ids(chat) else row[1] == 0
                verdict = C.ACCEPT if moves else C.IGNORE
            expected[seq, chat] = verdict
            batch.append(command(seq, "message_read", str(user), str(chat), str(given)))
    # One command per (position, chat): keep them apart by a finer position.
    wide = [dict(r, log_seq=r["log_seq"] * 10) for r in rows]
    events = cut_lineage(flag_hot(frame(spark, wide)))
    fine = [(c[0] * 10 - 9 + int(c[3]), *c[1:]) for c in batch]
    judged = C.admit_reads(*C.parse(spark.createDataFrame(fine, COMMAND), events))
    got = {((r.cmd_seq - r.chat_id + 9) // 10, r.chat_id): r.decision for r in judged.collect()}
    assert got == expected


def test_expanded_commands_replay_to_the_expected_state(spark):
    batch = spark.createDataFrame([command(100, "message_create", "1", "1", content="new")], COMMAND)
    base = log()[:5]
    events, _ = C.expand_commands(batch, flag_hot(frame(spark, base)))
    numbered = C.number_events(events, frame(spark, base)).orderBy("log_seq").collect()
    rows = base + [dict(r.asDict(), partition=1, offset=0) for r in numbered]
    state = replay(rows)
    assert state.messages[1, 3][:2] == (1, "new") and state.unread[1, 1] == (0, 3) and state.unread[2, 1] == (1, 1)


def test_ids_continue_after_a_rebuild(spark, skew):
    chats = spark.createDataFrame([(1, 0), (2, 5), (3, 0)], "id bigint, last_generated_message_id bigint")
    messages = spark.createDataFrame([(1, 4), (1, 2), (2, 9)], "chat_id bigint, id bigint")
    marks = message_id_high_water(chats, messages)
    assert {tuple(r) for r in marks.collect()} == {(1, 4), (2, 5), (3, 0)}
    wanted = spark.createDataFrame([(10, 1), (11, 3), (12, 1), (13, 2)], "cmd_seq bigint, chat_id bigint")
    per_chat = assign_ids(flag_hot(wanted), marks, "chat_id")
    assert {(r.cmd_seq, r.new_id) for r in per_chat.collect()} == {(10, 5), (11, 1), (12, 6), (13, 6)}
    assert {(r.cmd_seq, r.new_id) for r in assign_ids(wanted, 7).collect()} == {(10, 8), (11, 9), (12, 10), (13, 11)}


@pytest.mark.parametrize("text, number", [
    ("7", 7), ("+7", 7), ("-7", -7), ("007", 7), (" 7", None), ("7 ", None), ("", None), ("7.0", None), ("1e3", None),
    ("9223372036854775807", 2**63 - 1), ("9223372036854775808", None), (None, None),
])
def test_ids_from_text(spark, text, number):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(to_id(F.col("t"))).first()[0] == number


def test_flags_from_text(spark):
    texts = ["1", "t", "T", "true", "TRUE", "True", "0", "yes", "y", "tRUE", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(to_flag(F.col("t"))).collect()] == [True] * 6 + [False] * 6
