"""Schemas of the log, of its typed events and of the derived tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Open end of a validity interval [from_seq, to_seq).
OPEN = 2**63 - 1

# The wire names of the eleven events.
CHAT_CREATED = "chatCreated"
CHAT_EDITED = "chatEdited"
CHAT_DELETED = "chatDeleted"
PARTICIPANTS_ADDED = "participantsAdded"
PARTICIPANT_DELETED = "participantDeleted"
CHAT_PINNED = "chatPinned"
MESSAGE_CREATED = "messageCreated"
MESSAGE_EDITED = "messageEdited"
CHAT_VIEW_REFRESHED = "chatViewRefreshed"
MESSAGE_READED = "messageReaded"
MESSAGE_DELETED = "messageDeleted"

EVENT_NAMES = (
    CHAT_CREATED, CHAT_EDITED, CHAT_DELETED, PARTICIPANTS_ADDED, PARTICIPANT_DELETED, CHAT_PINNED,
    MESSAGE_CREATED, MESSAGE_EDITED, CHAT_VIEW_REFRESHED, MESSAGE_READED, MESSAGE_DELETED,
)

# Codes of the three actions of a view refresh (0 = no action).
UNREAD_REFRESH = 1
UNREAD_INCREASE = 2
LAST_MESSAGE_REFRESH = 1
CHAT_COMMON_REFRESH = 1

# Fixed value: longest chat title the title columns hold.
MAX_TITLE = 512

# One record of the log, laid out like a Kafka source row; headers are kept as a map.
RECORD = T.StructType([
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("key", T.StringType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("value", T.StringType()),
])

# The own fields of all events, as they are spelled in JSON.
EVENT_FIELDS = {
    "chatId": "bigint", "title": "string", "participantIds": "array<bigint>", "participantId": "bigint",
    "pinned": "boolean", "id": "bigint", "messageId": "bigint", "ownerId": "bigint", "content": "string",
    "unreadMessagesAction": "smallint", "lastMessageAction": "smallint", "chatCommonAction": "smallint",
    "increaseOn": "bigint",
}
EVENT_JSON = ", ".join([
    "additionalData struct<createdAt: string>", *[f"{name} {kind}" for name, kind in EVENT_FIELDS.items()], "broken string"])

# The decoded ("silver") log: one wide row per event.
EVENT = T.StructType([
    T.StructField("log_seq", T.LongType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("chat_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("participant_ids", T.ArrayType(T.LongType())),
    T.StructField("title", T.StringType()),
    T.StructField("participant_id", T.LongType()),
    T.StructField("pinned", T.BooleanType()),
    T.StructField("message_id", T.LongType()),
    T.StructField("owner_id", T.LongType()),
    T.StructField("content", T.StringType()),
    T.StructField("unread_action", T.ShortType()),
    T.StructField("last_message_action", T.ShortType()),
    T.StructField("chat_common_action", T.ShortType()),
    T.StructField("increase_on", T.LongType()),
])

EVENT_COLUMNS = tuple(EVENT.fieldNames())
