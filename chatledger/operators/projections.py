"""The stored tables of the chat service as closed forms over the log.

Every table is a grouped aggregate that keeps only positions and fixed-width values while it shuffles
(so rows are combined before the shuffle, also for a hot chat); texts are fetched afterwards by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatledger import schemas as S
from chatledger.operators.history import (
    member_rows, message_lives, message_versions, newest_at, users_of, valid_adds,
)
from chatledger.plans.materialize import cut_lineage
from chatledger.plans.ordered import as_of


def _at(name: str, *more: str) -> Column:
    return F.when(F.col("name").isin(name, *more), F.col("log_seq"))


def chat_common(events: DataFrame) -> DataFrame:
    """Chats that exist at the end of the log; the id counter is what a replay leaves (see ``high_water``)."""
    rows = events.where(F.col("name").isin(S.CHAT_CREATED, S.CHAT_EDITED, S.CHAT_DELETED))
    ends = rows.groupBy("chat_id").agg(
        F.max(_at(S.CHAT_CREATED)).alias("created"), F.max(_at(S.CHAT_DELETED)).alias("deleted"),
        F.max(_at(S.CHAT_CREATED, S.CHAT_EDITED)).alias("titled"),
    ).where("created > coalesce(deleted, -1)")
    texts = rows.select("chat_id", "log_seq", "title", "created_at")
    return (
        ends.join(texts.select("chat_id", F.col("log_seq").alias("created"), "created_at"), ["chat_id", "created"])
        .join(texts.select("chat_id", F.col("log_seq").alias("titled"), "title"), ["chat_id", "titled"])
        .select(
            F.col("chat_id").alias("id"), "title", F.lit(0).cast("long").alias("last_generated_message_id"),
            F.col("created_at").alias("created_timestamp"),
        )
    )


def messages(events: DataFrame) -> DataFrame:
    """Messages that exist at the end of the log, with the latest content."""
    rows = events.where(F.col("name").isin(S.MESSAGE_CREATED, S.MESSAGE_EDITED, S.MESSAGE_DELETED))
    ends = rows.groupBy("chat_id", "message_id").agg(
        F.max(_at(S.MESSAGE_CREATED)).alias("created"), F.max(_at(S.MESSAGE_DELETED)).alias("deleted"),
        F.max(_at(S.MESSAGE_CREATED, S.MESSAGE_EDITED)).alias("written"),
    ).where("created > coalesce(deleted, -1)")
    texts = rows.select("chat_id", "message_id", "log_seq", "owner_id", "content", "created_at")
    born = texts.select(
        "chat_id", "message_id", F.col("log_seq").alias("created"), "owner_id",
        F.col("created_at").alias("created_timestamp"),
    )
    wrote = texts.select(
        "chat_id", "message_id", F.col("log_seq").alias("written"), "content", F.col("created_at").alias("written_at")
    )
    return (
        ends.join(born, ["chat_id", "message_id", "created"]).join(wrote, ["chat_id", "message_id", "written"])
        .select(
            F.col("message_id").alias("id"), "chat_id", "owner_id", "content", "created_timestamp",
            F.when(F.col("written") > F.col("created"), F.col("written_at")).alias("updated_timestamp"),
        )
    )


def members(events: DataFrame) -> DataFrame:
    """Members at the end of the log: the last valid join is later than the last leave."""
    return member_rows(events).groupBy("user_id", "chat_id").agg(
        F.max(F.when(F.col("begins"), F.col("log_seq"))).alias("joined"),
        F.max(F.when(~F.col("begins"), F.col("log_seq"))).alias("left"),
    ).where("joined > coalesce(left, -1)").select("user_id", "chat_id")


def _view_marks(events: DataFrame, adds: DataFrame) -> DataFrame:
    """Per user and chat, the positions that decide each column of the user's view row.

    A row exists when the last valid add is later than the last removal; this add resets title and flag
    and refreshes the last message, so the latest operation of each kind always falls into the row's life.
    """
    refreshes = events.where(F.col("name") == S.CHAT_VIEW_REFRESHED)
    seq = F.col("log_seq")
    operations = users_of(adds).select(
        "user_id", "chat_id", "hot", seq.alias("touched"), seq.alias("titled"), seq.alias("previewed"),
        seq.alias("added"), (seq * 2).alias("flagged"),
    ).unionByName(
        users_of(refreshes, "last_message_action", "chat_common_action").select(
            "user_id", "chat_id", "hot", seq.alias("touched"),
            F.when(F.col("chat_common_action") == S.CHAT_COMMON_REFRESH, seq).alias("titled"),
            F.when(F.col("last_message_action") == S.LAST_MESSAGE_REFRESH, seq).alias("previewed"),
        ), allowMissingColumns=True,
    ).unionByName(
        events.where(F.col("name") == S.CHAT_PINNED).select(
            F.col("participant_id").alias("user_id"), "chat_id", "hot",
            (seq * 2 + F.col("pinned").cast("int")).alias("flagged"),
        ), allowMissingColumns=True,
    ).unionByName(
        users_of(events.where(F.col("name") == S.PARTICIPANT_DELETED)).select(
            "user_id", "chat_id", "hot", seq.alias("removed"),
        ), allowMissingColumns=True,
    )
    marks = operations.groupBy("user_id", "chat_id", "hot").agg(
        *[F.max(c).alias(c) for c in ("touched", "titled", "previewed", "added", "flagged", "removed")]
    )
    return marks.where("added > coalesce(removed, -1)")


def preview_texts(marks: DataFrame, events: DataFrame, lives: DataFrame | None = None) -> DataFrame:
    """The last message of a chat as a refresh at position ``previewed`` saw it: one row per refresh."""
    lives = cut_lineage(message_lives(events), events) if lives is None else lives
    refreshed = newest_at(marks.select("chat_id", F.col("previewed").alias("at"), "hot"), lives)
    found = as_of(
        refreshed.where("newest is not null").withColumnRenamed("newest", "id"), message_versions(events),
        ["chat_id", "id"], "at", "from_seq", ["content", "owner_id", "to_seq"],
    )
    return found.where("at < to_seq").select(
        "chat_id", F.col("at").alias("previewed"), F.col("id").alias("last_message_id"),
        F.col("content").alias("last_message_content"), F.col("owner_id").alias("last_message_owner_id"),
    )


def user_view(events: DataFrame, lives: DataFrame | None = None) -> DataFrame:
    """Every member's view of every chat: title, flag, time and last message as last copied to it."""
    adds = cut_lineage(valid_adds(events), events)
    marks = cut_lineage(_view_marks(events, adds), events)
    titles = adds.select("chat_id", F.col("log_seq").alias("titled"), F.col("chat_title").alias("title")).unionByName(
        events.where(
            (F.col("name") == S.CHAT_VIEW_REFRESHED) & (F.col("chat_common_action") == S.CHAT_COMMON_REFRESH)
        ).select("chat_id", F.col("log_seq").alias("titled"), "title")
    )
    times = events.where(F.col("name").isin(S.PARTICIPANTS_ADDED, S.CHAT_VIEW_REFRESHED)).select(
        "chat_id", F.col("log_seq").alias("touched"), F.col("created_at").alias("updated_timestamp")
    )
    return (
        marks.join(titles, ["chat_id", "titled"]).join(times, ["chat_id", "touched"])
        .join(preview_texts(marks, events, lives), ["chat_id", "previewed"], "left")
        .select(
            F.col("chat_id").alias("id"), "title", (F.col("flagged") % 2 == 1).alias("pinned"), "user_id",
            "updated_timestamp", "last_message_id", "last_message_content", "last_message_owner_id",
        )
    )


def last_messages(events: DataFrame, lives: DataFrame | None = None) -> DataFrame:
    """The last message every member's view shows, without the other columns of the view."""
    marks = cut_lineage(_view_marks(events, valid_adds(events)), events)
    return marks.join(preview_texts(marks, events, lives), ["chat_id", "previewed"], "left").select(
        "user_id", "chat_id", "last_message_id", "last_message_owner_id", "last_message_content"
    )


def pinned_chats(events: DataFrame) -> DataFrame:
    """Who pinned which chat."""
    marks = _view_marks(events, valid_adds(events))
    return marks.where("flagged % 2 = 1").select("user_id", "chat_id")
