"""The read queries over the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIST_COLUMNS = [
    "id", "title", "pinned", "unread_messages", "last_message_id", "last_message_owner_id", "last_message_content",
]


def list_order() -> list:
    """The order of a chat list: pinned first, then the latest, then the larger id."""
    return [F.col("pinned").desc(), F.col("updated_timestamp").desc(), F.col("id").desc()]


def chat_list(view: DataFrame, unread: DataFrame) -> DataFrame:
    """Everybody's chats with counters; a view row without a counter row is not listed."""
    counters = unread.select("user_id", F.col("chat_id").alias("id"), "unread_messages")
    return view.join(counters, ["user_id", "id"]).withColumn(
        "unread_messages", F.coalesce("unread_messages", F.lit(0))
    )


def chats_for_user(
    view: DataFrame, unread: DataFrame, user_id: int, *, after: tuple | None = None, limit: int | None = None
) -> DataFrame:
    """One user's chats in list order. ``after`` = (pinned, updated_timestamp, id) of the last row seen
    continues the list, ``limit`` cuts the page."""
    rows = chat_list(view.where(F.col("user_id") == user_id), unread.where(F.col("user_id") == user_id))
    if after is not None:
        pinned, updated, chat = after
        cursor = F.struct(
            F.lit(pinned).alias("pinned"), F.lit(updated).cast("timestamp_ntz").alias("updated_timestamp"),
            F.lit(chat).cast("long").alias("id"),
        )
        rows = rows.where(F.struct("pinned", "updated_timestamp", "id") < cursor)
    rows = rows.orderBy(*list_order())
    return rows if limit is None else rows.limit(limit)


def messages_of(
    messages: DataFrame, chat_id: int, *, before: int | None = None, limit: int | None = None
) -> DataFrame:
    """A chat's messages, newest first. ``before`` is the last id seen, ``limit`` cuts the page."""
    rows = messages.where(F.col("chat_id") == chat_id).select("id", "owner_id", "content")
    if before is not None:
        rows = rows.where(F.col("id") < before)
    rows = rows.orderBy(F.col("id").desc())
    return rows if limit is None else rows.limit(limit)


def participants_of(members: DataFrame, chat_id: int) -> DataFrame:
    """A chat's members by user id."""
    return members.where(F.col("chat_id") == chat_id).select("user_id").orderBy("user_id")


def titles(view: DataFrame, chats: DataFrame, user_id: int | None = None) -> DataFrame:
    """Current titles of the chats a user can see, through their view."""
    seen = view if user_id is None else view.where(F.col("user_id") == user_id)
    return seen.select("user_id", F.col("id").alias("chat_id")).join(
        chats.select(F.col("id").alias("chat_id"), "title"), "chat_id"
    ).select("user_id", "chat_id", "title")


def owners(messages: DataFrame, keys: DataFrame) -> DataFrame:
    """Owners of the given (``chat_id``, ``id``) messages that exist."""
    return keys.select("chat_id", "id").distinct().join(
        messages.select("chat_id", "id", "owner_id"), ["chat_id", "id"]
    )


def read_state(unread: DataFrame, messages: DataFrame) -> DataFrame:
    """Every marker, whether its message exists, and the newest id of the chat (null when empty)."""
    newest = messages.groupBy("chat_id").agg(F.max("id").alias("max_id"))
    present = messages.select("chat_id", F.col("id").alias("marker"), F.lit(True).alias("present"))
    rows = unread.select("user_id", "chat_id", F.col("last_message_id").alias("marker"))
    return rows.join(present, ["chat_id", "marker"], "left").join(newest, "chat_id", "left").select(
        "user_id", "chat_id", "marker", F.coalesce("present", F.lit(False)).alias("marker_exists"), "max_id"
    )


def last_ids(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """The newest message id of every chat, 0 when it has none."""
    newest = messages.groupBy("chat_id").agg(F.max("id").alias("last_id"))
    return chats.select(F.col("id").alias("chat_id")).join(newest, "chat_id", "left").select(
        "chat_id", F.coalesce("last_id", F.lit(0)).alias("last_id")
    )


def chat_ids(chats: DataFrame) -> DataFrame:
    """All chat ids, ascending."""
    return chats.select("id").orderBy("id")
