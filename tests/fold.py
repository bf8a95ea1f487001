"""The rules of the chat service taken one event after the other, in plain Python. Only tests use this."""

from __future__ import annotations

import datetime as dt

from chatledger import schemas as S

START = dt.datetime(2024, 1, 1)


def event(seq: int, chat: int, name: str, **fields) -> dict:
    """An event row with all columns; times follow the given minute, by default the position."""
    row = dict.fromkeys(S.EVENT_COLUMNS)
    row.update(log_seq=seq, partition=chat % 3, offset=seq, chat_id=chat, name=name)
    row["created_at"] = START + dt.timedelta(minutes=fields.pop("minute", seq))
    row.update(fields)
    return row


def refresh(seq: int, chat: int, ids: list[int], unread=0, message=0, common=0, **fields) -> dict:
    """A view refresh."""
    given = {"title": "", "owner_id": 0, "increase_on": 0, **fields}
    return event(seq, chat, S.CHAT_VIEW_REFRESHED, participant_ids=ids, unread_action=unread,
                 last_message_action=message, chat_common_action=common, **given)


def frame(spark, rows: list[dict]):
    """Events as a data frame."""
    return spark.createDataFrame([tuple(r[c] for c in S.EVENT_COLUMNS) for r in rows], S.EVENT)


class State:
    """All tables of the service."""

    def __init__(self) -> None:
        self.chats: dict = {}
        self.members: set = set()
        self.messages: dict = {}
        self.view: dict = {}
        self.unread: dict = {}
        self.marker_log: list = []

    def apply(self, e: dict) -> None:
        before = {k: v[1] for k, v in self.unread.items()}
        getattr(self, "on_" + e["name"])(e)
        for key, (_, marker) in self.unread.items():
            if before.get(key) != marker:
                self.marker_log.append((key, e["log_seq"], marker))

    def ids(self, chat: int) -> list[int]:
        return [i for c, i in self.messages if c == chat]

    def top(self, chat: int) -> int:
        return max(self.ids(chat), default=0)

    def on_chatCreated(self, e):
        self.chats[e["chat_id"]] = (e["title"], e["created_at"])

    def on_chatEdited(self, e):
        if e["chat_id"] in self.chats:
            self.chats[e["chat_id"]] = (e["title"], self.chats[e["chat_id"]][1])

    def on_chatDeleted(self, e):
        self.chats.pop(e["chat_id"], None)

    def on_participantsAdded(self, e):
        chat = e["chat_id"]
        if chat not in self.chats:
            return
        for user in set(e["participant_ids"] or []):
            self.members.add((user, chat))
            row = self.view.setdefault((user, chat), {"last": None})
            row.update(title=self.chats[chat][0], pinned=False, updated=e["created_at"])
            self.fill(user, chat, 0)
            self.preview(user, chat)

    def on_participantDeleted(self, e):
        for user in e["participant_ids"] or []:
            self.members.discard((user, e["chat_id"]))
            self.view.pop((user, e["chat_id"]), None)

    def on_chatPinned(self, e):
        key = (e["participant_id"], e["chat_id"])
        if key in self.view:
            self.view[key]["pinned"] = e["pinned"]

    def on_messageCreated(self, e):
        self.messages[e["chat_id"], e["message_id"]] = (e["owner_id"], e["content"], e["created_at"], None)

    def on_messageEdited(self, e):
        key = (e["chat_id"], e["message_id"])
        if key in self.messages:
            owner, _, created, _ = self.messages[key]
            self.messages[key] = (owner, e["content"], created, e["created_at"])

    def on_messageDeleted(self, e):
        self.messages.pop((e["chat_id"], e["message_id"]), None)

    def on_messageReaded(self, e):
        chat, given = e["chat_id"], e["message_id"]
        self.recount(e["participant_id"], chat, given if given in self.ids(chat) else self.top(chat))

    def on_chatViewRefreshed(self, e):
        chat, users = e["chat_id"], set(e["participant_ids"] or [])
        if e["unread_action"] == S.UNREAD_INCREASE:
            for user in users:
                if (user, chat) in self.unread:
                    count, marker = self.unread[user, chat]
                    owner = user == e["owner_id"]
                    self.unread[user, chat] = (count, self.top(chat)) if owner else (count + e["increase_on"], marker)
        elif e["unread_action"] == S.UNREAD_REFRESH:
            for user in users:
                self.fill(user, chat, self.top(chat))
        for user in users:
            if (user, chat) in self.view:
                row = self.view[user, chat]
                row["updated"] = e["created_at"]
                if e["last_message_action"] == S.LAST_MESSAGE_REFRESH:
                    self.preview(user, chat)
                if e["chat_common_action"] == S.CHAT_COMMON_REFRESH:
                    row["title"] = e["title"]

    def fill(self, user: int, chat: int, fallback: int) -> None:
        marker = self.unread.get((user, chat), (0, 0))[1]
        if marker > 0 and marker not in self.ids(chat):
            marker = fallback
        self.recount(user, chat, max(marker, 0))

    def recount(self, user: int, chat: int, marker: int) -> None:
        self.unread[user, chat] = (sum(i > marker for i in self.ids(chat)), marker)

    def preview(self, user: int, chat: int) -> None:
        ids = self.ids(chat)
        self.view[user, chat]["last"] = None if not ids else (max(ids), *self.messages[chat, max(ids)][:2])

    # The tables as sets of rows, in the column order of the library's tables

    def tables(self) -> dict[str, set]:
        return {
            "chat_common": {(c, t, at) for c, (t, at) in self.chats.items()},
            "members": set(self.members),
            "messages": {(i, c, *row) for (c, i), row in self.messages.items()},
            "view": {
                (c, r["title"], r["pinned"], u, r["updated"], *((r["last"][0], r["last"][2], r["last"][1])
                                                                if r["last"] else (None, None, None)))
                for (u, c), r in self.view.items()
            },
            "unread": {(u, c, n, m) for (u, c), (n, m) in self.unread.items()},
        }


def replay(rows: list[dict]) -> State:
    """All events in order."""
    state = State()
    for row in sorted(rows, key=lambda r: r["log_seq"]):
        state.apply(row)
    return state
