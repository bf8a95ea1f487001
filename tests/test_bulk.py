"""Bulk load: a batch that builds on itself equals one command after the other."""

from __future__ import annotations

import random

from chatledger import schemas as S
from chatledger.operators import bulk
from chatledger.operators import commands as C
from chatledger.plans.skew import flag_hot
from tests.fold import START, State, event, frame, refresh, replay
from tests.test_commands import COMMAND, command


class Service:
    """Takes one command after the other, as the service does, and applies its events at once."""

    def __init__(self) -> None:
        self.state, self.events, self.refused, self.chats = State(), [], {}, 0
        self.counters: dict[int, int] = {}

    def members(self, chat: int) -> list[int]:
        return sorted(u for u, c in self.state.members if c == chat)

    def take(self, c: tuple) -> None:
        seq, kind, user, chat, message, title, content, pin, ids, _ = c
        try:
            user = int(user)
            chat = None if kind == "chat_create" else int(chat)
            message = int(message) if kind in ("message_edit", "message_delete", "message_read") else None
        except (TypeError, ValueError):
            self.refused[seq] = C.BAD_ID
            return
        out = getattr(self, kind)(user, chat, message, title, content, pin, ids)
        if isinstance(out, str):
            self.refused[seq] = out
            return
        for e in out:
            e["log_seq"] = len(self.events)
            e["created_at"] = START
            self.events.append(e)
            self.state.apply(e)

    def chat_create(self, user, chat, message, title, content, pin, ids):
        self.chats += 1
        self.counters[self.chats] = 0
        return [event(0, self.chats, S.CHAT_CREATED, title=title),
                event(0, self.chats, S.PARTICIPANTS_ADDED, participant_ids=ids if user in ids else [*ids, user])]

    def chat_edit(self, user, chat, message, title, content, pin, ids):
        out = [event(0, chat, S.CHAT_EDITED, title=title)]
        if ids:
            out.append(event(0, chat, S.PARTICIPANTS_ADDED, participant_ids=ids))
        return [*out, refresh(0, chat, self.members(chat), common=1, title=title)]

    def chat_delete(self, user, chat, *_):
        return [event(0, chat, S.CHAT_DELETED), event(0, chat, S.PARTICIPANT_DELETED, participant_ids=self.members(chat))]

    def participant_add(self, user, chat, message, title, content, pin, ids):
        return [event(0, chat, S.PARTICIPANTS_ADDED, participant_ids=ids)]

    def participant_delete(self, user, chat, message, title, content, pin, ids):
        return [event(0, chat, S.PARTICIPANT_DELETED, participant_ids=ids)]

    def chat_pin(self, user, chat, message, title, content, pin, ids):
        return [event(0, chat, S.CHAT_PINNED, participant_id=user, pinned=pin == "true")]

    def message_create(self, user, chat, message, title, content, pin, ids):
        if chat not in self.state.chats:
            return C.NO_CHAT
        self.counters[chat] += 1
        return [event(0, chat, S.MESSAGE_CREATED, message_id=self.counters[chat], owner_id=user, content=content),
                refresh(0, chat, self.members(chat), unread=2, message=1, increase_on=1, owner_id=user)]

    def owner(self, user, chat, message):
        row = self.state.messages.get((chat, message))
        return C.NO_MESSAGE if row is None else None if row[0] == user else C.NOT_OWNER

    def message_edit(self, user, chat, message, title, content, pin, ids):
        if problem := self.owner(user, chat, message):
            return problem
        out = [event(0, chat, S.MESSAGE_EDITED, message_id=message, content=content)]
        return out + ([refresh(0, chat, self.members(chat), message=1)] if message == self.state.top(chat) else [])

    def message_delete(self, user, chat, message, *_):
        return self.owner(user, chat, message) or [
            event(0, chat, S.MESSAGE_DELETED, message_id=message),
            refresh(0, chat, self.members(chat), unread=1, message=1, owner_id=user)]

    def message_read(self, user, chat, message, *_):
        row, there = self.state.unread.get((user, chat)), self.state.ids(chat)
        if row is None or not there:
            return C.NO_STATE
        given = min(message, max(there))
        moves = given > row[1] if row[1] in there else row[1] == 0
        return [event(0, chat, S.MESSAGE_READED, participant_id=user, message_id=given)] if moves else []


def random_batch(seed: int, size: int, chats: int = 5, users: int = 4) -> list[tuple]:
    rnd, out, newest = random.Random(seed), [], dict.fromkeys(range(chats + 2), 0)
    for seq in range(1, size + 1):
        seq = seq * 3  # positions have gaps
        user, chat = str(rnd.randrange(users)), rnd.randint(0, chats + 1)
        ids = rnd.choices(range(users), k=rnd.randint(0, 3))
        some = str(max(0, newest[chat] - rnd.choice([0, 0, 0, 1, 2, 4])))
        roll = rnd.random() if len(out) >= chats else 0
        if roll < 0.02:
            out.append(command(seq, "chat_create", user, None, title=f"c{seq}", participant_ids=ids))
        elif roll < 0.05:
            out.append(command(seq, "chat_edit", user, str(chat), title=f"e{seq}", participant_ids=rnd.choice([ids, []])))
        elif roll < 0.055:
            out.append(command(seq, "chat_delete", user, str(chat)))
        elif roll < 0.15:
            out.append(command(seq, "participant_add", user, str(chat), participant_ids=ids))
        elif roll < 0.17:
            out.append(command(seq, "participant_delete", user, str(chat), participant_ids=ids))
        elif roll < 0.19:
            out.append(command(seq, "chat_pin", user, str(chat), pin_text=rnd.choice(["true", "no"])))
        elif roll < 0.45:
            newest[chat] += 1
            out.append(command(seq, "message_create", user, str(chat), content=f"m{seq}"))
        elif roll < 0.50:
            out.append(command(seq, "message_edit", user, str(chat), some, content=f"x{seq}"))
        elif roll < 0.65:
            out.append(command(seq, "message_delete", user, str(chat), some))
        elif roll < 0.98:
            out.append(command(seq, "message_read", user, str(chat), str(int(some) + rnd.randint(-1, 2))))
        else:
            out.append(command(seq, "message_read", user, str(chat) + "x", some))
    return out


def compare(spark, batch: list[tuple], page: int = C.PAGE) -> Service:
    service = Service()
    for c in batch:
        service.take(c)
    expanded, refused = bulk.expand_batch(spark.createDataFrame(batch, COMMAND), page=page)
    empty = frame(spark, [])
    got = [dict(r.asDict(), partition=None, offset=None) for r in C.number_events(expanded, empty).orderBy("log_seq").collect()]
    assert {r.cmd_seq: r.reason for r in refused.collect()} == service.refused
    if page == C.PAGE:
        assert [{**e, "partition": None, "offset": None} for e in service.events] == got
    assert replay(got).tables() == service.state.tables()
    return service


def test_a_story(spark):
    batch = [
        command(1, "chat_create", "1", None, title="t", participant_ids=[2]), command(2, "participant_add", chat="1", participant_ids=[3]),
        command(3, "message_create", "1", "1", content="a"), command(4, "message_read", "2", "1", "1"),
        command(5, "message_delete", "2", "1", "1"), command(6, "message_delete", "1", "1", "1"),
        command(7, "message_read", "2", "1", "1"), command(8, "message_create", "3", "1", content="b"),
        command(9, "message_read", "2", "1", "9"), command(10, "message_read", "2", "1", "2"),
        command(11, "chat_delete", "1", "1"), command(12, "message_create", "1", "1", content="late"),
    ]
    service = compare(spark, batch)
    assert service.refused == {5: C.NOT_OWNER, 7: C.NO_STATE, 12: C.NO_CHAT}


def test_random_batches(spark, skew):
    """As one event for each list, and (with hot chats) as two members to an event."""
    service = compare(spark, random_batch(1, 900), page=C.PAGE if skew == "plain" else 2)
    names = [e["name"] for e in service.events]
    assert min(names.count(n) for n in (S.MESSAGE_READED, S.MESSAGE_DELETED, S.MESSAGE_EDITED)) >= 5


def test_an_empty_batch(spark):
    expanded, refused = bulk.expand_batch(spark.createDataFrame([], COMMAND))
    assert expanded.isEmpty() and refused.isEmpty()
    assert C.number_events(expanded, flag_hot(frame(spark, []))).isEmpty()
