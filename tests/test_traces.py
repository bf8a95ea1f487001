"""Short stories with known outcomes: the service's own scenarios and a few more."""

from __future__ import annotations

import copy

import pytest

from chatledger import schemas as S
from chatledger.operators import projections as P
from chatledger.operators import reads as R
from chatledger.operators import unread as U
from chatledger.plans.skew import flag_hot
from tests.fold import event, frame, refresh


class Story:
    """Writes the events a series of commands leads to, one chat at a time."""

    def __init__(self, chat: int = 1) -> None:
        self.rows: list[dict] = []
        self.chat, self.members, self.newest = chat, [], 0

    def add(self, name: str, **fields):
        self.rows.append(event(len(self.rows), self.chat, name, **fields))
        return self

    def refresh(self, **fields):
        self.rows.append(refresh(len(self.rows), self.chat, list(self.members), **fields))
        return self

    def create(self, title: str, *users: int):
        self.add(S.CHAT_CREATED, title=title)
        return self.join(*users)

    def join(self, *users: int):
        self.members += [u for u in users if u not in self.members]
        return self.add(S.PARTICIPANTS_ADDED, participant_ids=list(users))

    def leave(self, *users: int):
        self.members = [u for u in self.members if u not in users]
        return self.add(S.PARTICIPANT_DELETED, participant_ids=list(users))

    def rename(self, title: str):
        return self.add(S.CHAT_EDITED, title=title).refresh(common=1, title=title)

    def post(self, user: int, text: str):
        self.newest += 1
        self.add(S.MESSAGE_CREATED, message_id=self.newest, owner_id=user, content=text)
        return self.refresh(unread=2, message=1, increase_on=1, owner_id=user)

    def edit(self, message: int, text: str):
        self.add(S.MESSAGE_EDITED, message_id=message, content=text)
        return self.refresh(message=1) if message == self.newest else self

    def erase(self, user: int, message: int):
        return self.add(S.MESSAGE_DELETED, message_id=message).refresh(unread=1, message=1, owner_id=user)

    def read(self, user: int, message: int):
        return self.add(S.MESSAGE_READED, participant_id=user, message_id=message)

    def pin(self, user: int, pinned: bool = True):
        return self.add(S.CHAT_PINNED, participant_id=user, pinned=pinned)

    def delete(self):
        self.add(S.CHAT_DELETED)
        return self.leave(*self.members)

    def snapshot(self):
        return copy.deepcopy(self)


def stories() -> dict[str, Story]:
    """All stories, some of them at several points."""
    out: dict[str, Story] = {}
    s = Story().create("new chat 1", 1).post(1, "m1")
    out["posted"] = s.snapshot()
    out["joined"] = s.join(2, 3).snapshot()
    out["read"] = s.read(2, 1).snapshot()
    out["posted more"] = s.post(1, "m2").post(1, "m3").snapshot()
    out["erased"] = s.erase(1, 3).snapshot()
    two = Story().create("new chat 1", 1).post(1, "m1").join(2)
    out["two"] = two.snapshot()
    out["pinned"] = two.snapshot().pin(1)
    out["deleted"] = two.snapshot().delete()
    out["renamed"] = two.snapshot().rename("renamed")
    out["left"] = two.snapshot().leave(2)
    out["old edited"] = Story().create("new chat 1", 1).post(1, "m1").post(1, "m2").edit(1, "old edited")
    out["new edited"] = out["old edited"].snapshot().edit(2, "new edited")
    base = Story().create("c", 1, 2)
    out["marker message deleted"] = (
        base.snapshot().post(1, "1").post(1, "2").post(1, "3").post(1, "4").read(2, 2).erase(1, 2)
    )
    out["poster with unread"] = base.snapshot().post(1, "1").post(2, "2")
    out["re-added"] = base.snapshot().post(1, "1").read(2, 1).leave(2).post(1, "2").join(2)
    out["owner increase without messages"] = base.snapshot().refresh(unread=2, increase_on=1, owner_id=1)
    out["recreated"] = Story().create("first", 1).post(1, "m1").pin(1).delete().create("second", 1)
    return out


class Outcome:
    """The tables after every story, each story in a chat of its own; computed together."""

    def __init__(self, spark) -> None:
        self.chat = {label: i + 1 for i, label in enumerate(stories())}
        rows = []
        for label, story in stories().items():
            for r in story.rows:
                rows.append(dict(r, chat_id=self.chat[label], log_seq=len(rows)))
        events = flag_hot(frame(spark, rows))
        self.view, self.unread = P.user_view(events).collect(), U.unread(events).collect()
        self.members, self.messages = P.members(events).collect(), P.messages(events).collect()
        self.chats = {r.id for r in P.chat_common(events).collect()}

    def counters(self, label: str) -> dict:
        return {r.user_id: (r.unread_messages, r.last_message_id) for r in self.unread if r.chat_id == self.chat[label]}

    def seen(self, label: str, user: int):
        return next((r for r in self.view if r.id == self.chat[label] and r.user_id == user), None)

    def users(self, label: str) -> list:
        return sorted(r.user_id for r in self.members if r.chat_id == self.chat[label])


@pytest.fixture(scope="module")
def told(spark):
    return Outcome(spark)


@pytest.mark.parametrize("label, expected", [
    ("posted", {1: (0, 1)}),
    ("joined", {1: (0, 1), 2: (1, 0), 3: (1, 0)}),
    ("read", {1: (0, 1), 2: (0, 1), 3: (1, 0)}),
    ("posted more", {1: (0, 3), 2: (2, 1), 3: (3, 0)}),
    ("erased", {1: (0, 2), 2: (1, 1), 3: (2, 0)}),
    ("renamed", {1: (0, 1), 2: (1, 0)}),
    ("marker message deleted", {1: (0, 4), 2: (0, 4)}),
    ("poster with unread", {1: (1, 1), 2: (1, 2)}),
    ("re-added", {1: (0, 2), 2: (1, 1)}),
    ("owner increase without messages", {1: (0, 0), 2: (1, 0)}),
])
def test_counters(told, label, expected):
    assert told.counters(label) == expected


def test_members_and_lists(told):
    assert told.users("joined") == [1, 2, 3] and told.users("left") == [1]
    assert told.seen("posted", 2) is None and told.seen("left", 2) is None


def test_pin_is_personal(told):
    mine, theirs = told.seen("pinned", 1), told.seen("pinned", 2)
    assert (mine.pinned, mine.last_message_id, mine.last_message_content) == (True, 1, "m1")
    assert (theirs.pinned, theirs.last_message_id, theirs.last_message_content) == (False, 1, "m1")


def test_deleted_chat_leaves_the_lists_but_not_the_messages(told):
    chat = told.chat["deleted"]
    assert told.seen("deleted", 1) is None and told.seen("deleted", 2) is None and chat not in told.chats
    assert [r.id for r in told.messages if r.chat_id == chat] == [1] and len(told.counters("deleted")) == 2


def test_rename_reaches_everybody_and_new_members_see_the_last_message(told):
    assert told.seen("two", 2).last_message_content == "m1"
    for user in (1, 2):
        assert (told.seen("renamed", user).title, told.seen("renamed", user).last_message_content) == ("renamed", "m1")


def test_only_the_newest_edit_changes_the_preview(told):
    assert told.seen("old edited", 1).last_message_content == "m2"
    assert told.seen("new edited", 1).last_message_content == "new edited"
    texts = {r.id: r.content for r in told.messages if r.chat_id == told.chat["new edited"]}
    assert texts == {1: "old edited", 2: "new edited"}


def test_recreated_chat_shows_old_messages(told):
    row = told.seen("recreated", 1)
    assert (row.title, row.last_message_content, row.pinned) == ("second", "m1", False)


def test_pages_follow_the_list_order(spark):
    clock = lambda n: event(0, 1, S.CHAT_DELETED, minute=n)["created_at"]
    rows = [(c, f"c{c}", c in (2, 5), 1, clock(c // 2), None, None, None) for c in range(1, 8)]
    view = spark.createDataFrame(rows, """id bigint, title string, pinned boolean, user_id bigint,
        updated_timestamp timestamp_ntz, last_message_id bigint, last_message_content string,
        last_message_owner_id bigint""")
    unread = spark.createDataFrame([(1, c, c) for c in range(1, 8)], "user_id bigint, chat_id bigint, unread_messages bigint")
    whole = [r.id for r in R.chats_for_user(view, unread, 1).collect()]
    assert whole == [5, 2, 7, 6, 4, 3, 1]
    assert R.chats_for_user(view, unread, 2).collect() == []
    found, cursor = [], None
    while page := R.chats_for_user(view, unread, 1, after=cursor, limit=3).collect():
        found += [r.id for r in page]
        cursor = (page[-1].pinned, page[-1].updated_timestamp, page[-1].id)
    assert found == whole
    messages = spark.createDataFrame([(i, 1, 1, "m") for i in range(5)], "id bigint, chat_id bigint, owner_id bigint, content string")
    assert [r.id for r in R.messages_of(messages, 1, before=3, limit=2).collect()] == [2, 1]
