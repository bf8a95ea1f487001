"""Decoding, routing and checking of log records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatledger import schemas as S
from chatledger.functions.event_json import OWN_FIELDS, decode_value, is_event, is_plain, strict_json, utc_clock
from chatledger.operators.history import message_lives, newest_at
from chatledger.plans.materialize import cut_lineage
from chatledger.plans.ordered import following, previous, running, total
from chatledger.sources.log import dedup, log_position


def decode(records: DataFrame, partitions: int | None = None) -> DataFrame:
    """Raw records as wide event rows. ``broken`` marks values that are not events: no JSON object, text after it, or a
    field of the wrong type; ``split_known`` takes them out, with the records of unknown names.

    A field that an event has but its value lacks (or holds as null) is zero, false or empty text; a missing list stays
    null, which is as empty. ``partitions`` is the partition count of a log whose producers stamp no position.
    """
    parsed = records.withColumn("name", F.col("headers")["name"]).withColumn("e_", decode_value("value"))
    e = lambda c: F.col(f"e_.{c}")

    def own(field: str, zero: object) -> Column:
        events = [name for name, fields in OWN_FIELDS.items() if field in fields]
        return F.when(F.col("name").isin(*events), F.coalesce(e(field), F.lit(zero)))

    lists = F.col("name").isin(*[name for name, fields in OWN_FIELDS.items() if "participantIds" in fields])
    number = lambda field, kind="bigint": own(field, 0).cast(kind)
    # The partition id keeps filters above the parsing, which they would repeat for every field they ask for.
    parsed = parsed.withColumn("plain_", is_plain("value", "e_") & (F.spark_partition_id() >= 0))
    parsed = parsed.withColumn("v_", F.when(~F.col("plain_"), strict_json("value")))
    parsed = parsed.withColumn("clock_", utc_clock("e_.additionalData.createdAt"))
    # Here too, or the filter on the verdict would judge every value once more.
    judged = ~is_event(F.col("plain_"), "v_", "name", "e_", "clock_") & (F.spark_partition_id() >= 0)
    parsed = parsed.withColumn("broken", judged)
    decoded = parsed.select(
        log_position(partitions=partitions).alias("log_seq"), "partition", "offset",
        F.coalesce(e("chatId"), F.when(F.col("e_").isNotNull(), F.lit(0))).cast("bigint").alias("chat_id"), "name",
        F.col("clock_").alias("created_at"),
        F.when(lists, F.transform(e("participantIds"), lambda i: F.coalesce(i, F.lit(0)))).alias("participant_ids"),
        own("title", "").alias("title"), number("participantId").alias("participant_id"),
        own("pinned", False).alias("pinned"),
        F.coalesce(number("id"), number("messageId")).alias("message_id"),
        number("ownerId").alias("owner_id"), own("content", "").alias("content"),
        number("unreadMessagesAction", "smallint").alias("unread_action"),
        number("lastMessageAction", "smallint").alias("last_message_action"),
        number("chatCommonAction", "smallint").alias("chat_common_action"),
        number("increaseOn").alias("increase_on"), "broken",
    )
    # What could be read of a broken value is not an event's.
    keep = ("log_seq", "partition", "offset", "name", "broken")
    return decoded.select(*[c if c in keep else F.when(~F.col("broken"), F.col(c)).alias(c) for c in decoded.columns])


# Reasons an event is taken out of the replay or reported.
UNKNOWN_NAME = "unknown event name"
BROKEN_VALUE = "value is not an event"
LONG_TITLE = "title too long"
REPEATED_ID = "participant listed twice"
NO_MESSAGE = "owner increase in a chat without messages"


def rejects(events: DataFrame) -> DataFrame:
    """Events that are not applied: unknown name, a broken value, no position, or a title over the limit."""
    broken = F.coalesce("broken", F.lit(False)) if "broken" in events.columns else F.lit(False)
    titled = F.col("name").isin(S.CHAT_CREATED, S.CHAT_EDITED) | (
        (F.col("name") == S.CHAT_VIEW_REFRESHED) & (F.col("chat_common_action") == S.CHAT_COMMON_REFRESH)
    )
    reason = (
        F.when(~F.coalesce(F.col("name").isin(*S.EVENT_NAMES), F.lit(False)), UNKNOWN_NAME)
        .when(broken | F.col("chat_id").isNull() | F.col("log_seq").isNull(), BROKEN_VALUE)
        .when(titled & (F.char_length("title") > S.MAX_TITLE), LONG_TITLE)
    )
    return events.withColumn("reason", reason)


def split_known(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The events to apply, and the dead letters with a reason."""
    judged = rejects(events)
    return judged.where("reason is null").drop("reason", "broken"), judged.where("reason is not null").drop("broken")


def read_events(records: DataFrame, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Raw records as the events to apply, and the dead letters with a reason. Redelivered records count once. This is
    the one way from a log to events, for batches, imports and streams."""
    return split_known(decode(dedup(records), partitions))


def route(events: DataFrame) -> DataFrame:
    """How many events each of the eleven handlers gets, from one scan."""
    return events.where(F.col("name").isin(*S.EVENT_NAMES)).groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("chat_id").alias("chats"),
        F.min("log_seq").alias("first_seq"), F.max("log_seq").alias("last_seq"),
    )


def order_in_chat(events: DataFrame) -> DataFrame:
    """Every event's place in its chat, with the names of its neighbours."""
    return running(
        events.select("chat_id", "log_seq", "name", "hot"), ["chat_id"], ["log_seq"],
        pos=total(F.lit(1)), prev_name=previous(F.col("name")), next_name=following(F.col("name")),
    ).drop("hot")


def poison(events: DataFrame) -> DataFrame:
    """Events that could never be applied as they are, with the reason: over-long titles, users listed
    twice where rows are written per user, and an owner's increase while the chat has no message."""
    name = F.col("name")
    writes_rows = (name == S.PARTICIPANTS_ADDED) | (
        (name == S.CHAT_VIEW_REFRESHED) & (F.col("unread_action") == S.UNREAD_REFRESH)
    )
    repeats = F.size("participant_ids") > F.size(F.array_distinct("participant_ids"))
    lives = cut_lineage(message_lives(events), events)
    long = rejects(events).where(F.col("reason") == LONG_TITLE).select("log_seq", "reason")
    twice = events.where(writes_rows & repeats).select("log_seq", F.lit(REPEATED_ID).alias("reason"))
    owned = events.where(
        (name == S.CHAT_VIEW_REFRESHED) & (F.col("unread_action") == S.UNREAD_INCREASE)
        & F.array_contains("participant_ids", F.col("owner_id"))
    ).select("chat_id", F.col("log_seq").alias("at"), "hot")
    empty = newest_at(owned, lives).where("newest is null").select(
        F.col("at").alias("log_seq"), F.lit(NO_MESSAGE).alias("reason")
    )
    return long.unionByName(twice).unionByName(empty)
