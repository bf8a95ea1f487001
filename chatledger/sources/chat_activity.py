"""The chat log and the commands derived from the ``events`` table by column rules.

Every source row becomes one chat action (post, edit, read, join, …). Actions turn into one to four
log events, or into one command, depending on what is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatledger import schemas as S
from chatledger.functions.event_json import encode_value
from chatledger.plans.ordered import running, total
from chatledger.plans.skew import flag_hot
from chatledger.sources.log import append_log, remainder_partition

# Partitions of the derived log.
PARTITIONS = 3
MEMBERS = 5


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chat action per row of ``events``, with its place in the chat and the newest message id."""
    source = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"),
        F.expr(f"user_id div {MEMBERS}").alias("block"),
    )
    s = F.expr("k div 4")
    kind, low = F.col("event_type"), F.col("s")
    acts = (
        source.withColumn("s", s)
        .withColumn("chat_id", F.col("block") * 4 + F.col("k") % 4 + 1)
        .withColumn("act", F.when((kind == "purchase") | ((kind == "view") & (low < 20)), "msg")
                    .when(kind == "view", "pin")
                    .when((kind == "signup") & (low < 20), "add")
                    .when((kind == "signup") & (low == 20), "edit")
                    .when((kind == "signup") & (low == 21), "create")
                    .when((kind == "signup") | ((kind == "error") & (low >= 20) & (low < 24)), "leave")
                    .when(kind == "click", "read")
                    .when((kind == "error") & (low < 10), "medit")
                    .when((kind == "error") & (low < 20), "mdel")
                    .when(kind == "error", "cdel"))
        .where("act is not null")
    )
    return running(
        flag_hot(acts), ["chat_id"], ["event_id"],
        rn=total(F.lit(1)), mx=total(F.when(F.col("act") == "msg", 1).otherwise(0)),
    )


def chat_events(acts: DataFrame) -> DataFrame:
    """The typed events of the actions: the wide event columns, without partition and offset.

    Each action first becomes the list of (slot, name) of its events; the fields follow from the name.
    """
    act, user, event_id = F.col("act"), F.col("user_id"), F.col("event_id").cast("string")
    name, slot = F.col("e.name"), F.col("e.slot")

    def emit(when: Column, at: int, event: str) -> Column:
        return F.when(when, F.struct(F.lit(at).alias("slot"), F.lit(event).alias("name")))

    starts = (F.col("rn") == 1) | (act == "create")
    refreshing = act.isin("msg", "edit", "medit", "mdel")
    emitted = F.array(
        emit(starts, 0, S.CHAT_CREATED),
        emit(starts, 1, S.PARTICIPANTS_ADDED),
        emit(act == "msg", 2, S.MESSAGE_CREATED),
        emit(act == "pin", 2, S.CHAT_PINNED),
        emit(act == "add", 2, S.PARTICIPANTS_ADDED),
        emit(act == "edit", 2, S.CHAT_EDITED),
        emit(act == "leave", 2, S.PARTICIPANT_DELETED),
        emit(act == "read", 2, S.MESSAGE_READED),
        emit(act == "medit", 2, S.MESSAGE_EDITED),
        emit(act == "mdel", 2, S.MESSAGE_DELETED),
        emit(act == "cdel", 2, S.CHAT_DELETED),
        emit(refreshing, 3, S.CHAT_VIEW_REFRESHED),
        emit(act == "cdel", 3, S.PARTICIPANT_DELETED),
    )
    rows = acts.withColumn("e", F.explode(F.array_compact(emitted)))

    everyone = F.transform(F.sequence(F.lit(0), F.lit(MEMBERS - 1)), lambda i: F.col("block") * MEMBERS + i)
    recent = F.greatest(F.lit(0), F.col("mx") - F.col("s") % 3)
    doomed = F.greatest(F.lit(0), F.col("mx") - F.col("s") % 4)
    new_title = F.concat(F.lit("t"), event_id)
    first_title = F.concat(F.lit("chat "), F.col("chat_id").cast("string"), F.lit("."), event_id)
    refresh = name == S.CHAT_VIEW_REFRESHED

    def action(when: Column, code: int) -> Column:
        return F.when(refresh, F.when(when, code).otherwise(0)).cast("smallint")

    return rows.select(
        (F.col("event_id") * 4 + slot).alias("log_seq"), "chat_id", name.alias("name"), F.col("ts").alias("created_at"),
        F.when(refresh | (act == "cdel") & (slot == 3), everyone)
        .when(slot == 1, F.slice(everyone, 1, 2))
        .when(name.isin(S.PARTICIPANTS_ADDED, S.PARTICIPANT_DELETED), F.array(user)).alias("participant_ids"),
        F.when(name == S.CHAT_CREATED, first_title).when(act == "edit", F.when((slot == 2) | refresh, new_title))
        .when(refresh, "").alias("title"),
        F.when(name.isin(S.CHAT_PINNED, S.MESSAGE_READED), user).alias("participant_id"),
        F.when(name == S.CHAT_PINNED, F.col("value") >= 10).alias("pinned"),
        F.when(name == S.MESSAGE_CREATED, F.col("mx")).when(name.isin(S.MESSAGE_READED, S.MESSAGE_EDITED), recent)
        .when(name == S.MESSAGE_DELETED, doomed).alias("message_id"),
        F.when((name == S.MESSAGE_CREATED) | refresh & act.isin("msg", "mdel"), user)
        .when(refresh, 0).cast("long").alias("owner_id"),
        F.when(name == S.MESSAGE_CREATED, F.concat(F.lit("m"), event_id))
        .when(name == S.MESSAGE_EDITED, F.concat(F.lit("e"), event_id)).alias("content"),
        F.when(refresh, F.when(act == "msg", S.UNREAD_INCREASE).when(act == "mdel", S.UNREAD_REFRESH).otherwise(0))
        .cast("smallint").alias("unread_action"),
        action(act != "edit", S.LAST_MESSAGE_REFRESH).alias("last_message_action"),
        action(act == "edit", S.CHAT_COMMON_REFRESH).alias("chat_common_action"),
        F.when(refresh, F.when(act == "msg", 1).otherwise(0)).cast("long").alias("increase_on"),
    )


def as_records(events: DataFrame) -> DataFrame:
    """Typed events as raw log records: text key, JSON value, name and position in the headers."""
    return events.select(
        "partition", "offset", "key",
        F.create_map(F.lit("name"), F.col("name"),
                     F.lit("log_seq"), F.col("log_seq").cast("string")).alias("headers"),
        encode_value().alias("value"),
    )


def chat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived log as raw records."""
    events = chat_events(actions(spark, sf_dir))
    return as_records(append_log(events, PARTITIONS, partitioner=remainder_partition))


def commands(acts: DataFrame) -> DataFrame:
    """One command per action; ``cmd_seq`` is its position, before the log events of the same row."""
    act, user, event_id = F.col("act"), F.col("user_id"), F.col("event_id").cast("string")
    first_two = F.array(F.col("block") * MEMBERS, F.col("block") * MEMBERS + 1)
    even = F.col("k") % 2 == 0
    none = F.array().cast("array<bigint>")
    recent = F.greatest(F.lit(0), F.col("mx") - F.col("s") % 3)
    doomed = F.greatest(F.lit(0), F.col("mx") - F.col("s") % 4)
    # The pin texts that do not mean true.
    unpinned = F.element_at(F.array(F.lit("false"), F.lit("yes"), F.lit("")), (F.col("k") % 3 + 1).cast("int"))
    names = {
        "msg": "message_create", "medit": "message_edit", "mdel": "message_delete", "read": "message_read",
        "pin": "chat_pin", "add": "participant_add", "leave": "participant_delete", "edit": "chat_edit",
        "create": "chat_create", "cdel": "chat_delete",
    }
    kind = F.lit(None).cast("string")
    for source, target in names.items():
        kind = F.when(act == source, target).otherwise(kind)
    # Of a post, ``mx`` counts the post itself; the other actions see the messages before them.
    return acts.select(
        (F.col("event_id") * 4).alias("cmd_seq"), kind.alias("kind"),
        F.col("user_id").cast("string").alias("user_text"),
        F.when(act != "create", F.col("chat_id").cast("string")).alias("chat_text"),
        F.when(act == "medit", recent).when(act == "mdel", doomed)
        .when(act == "read", recent + F.col("k") % 2).cast("string").alias("message_text"),
        F.when(act == "edit", F.concat(F.lit("t"), event_id))
        .when(act == "create", F.concat(F.lit("c"), event_id)).alias("title"),
        F.when(act == "msg", F.concat(F.lit("m"), event_id))
        .when(act == "medit", F.concat(F.lit("e"), event_id)).alias("content"),
        F.when(act == "pin", F.when(F.col("value") >= 10, "true").otherwise(unpinned)).alias("pin_text"),
        F.when(act == "create", first_two).when(act.isin("add", "leave"), F.array(user))
        .when(act == "edit", F.when(even, F.array(user)).otherwise(none)).alias("participant_ids"),
        F.col("ts").alias("created_at"),
    )
