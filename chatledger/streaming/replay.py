"""Full replay of the log into all derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatledger.operators.history import message_lives
from chatledger.operators.ids import message_id_high_water
from chatledger.operators.projections import chat_common, members, messages, user_view
from chatledger.operators.unread import unread
from chatledger.plans.materialize import cut_lineage
from chatledger.streaming.digests import changed, table_digest

# The derived tables and the columns that identify a row.
TABLES = {
    "chat_common": ["id"],
    "chat_participant": ["user_id", "chat_id"],
    "message": ["chat_id", "id"],
    "chat_user_view": ["user_id", "id"],
    "unread_messages_user_view": ["user_id", "chat_id"],
}


def replay_full(events: DataFrame) -> dict[str, DataFrame]:
    """All tables as of the end of the log, with the message counters of the chats restored."""
    lives = cut_lineage(message_lives(events), events)
    texts = messages(events)
    chats = chat_common(events)
    marks = message_id_high_water(chats, texts).select(F.col("chat_id").alias("id"), "mark")
    restored = chats.join(marks, "id").select(
        "id", "title", F.col("mark").alias("last_generated_message_id"), "created_timestamp"
    )
    return {
        "chat_common": restored,
        "chat_participant": members(events),
        "message": texts,
        "chat_user_view": user_view(events, lives),
        "unread_messages_user_view": unread(events, lives),
    }


def stored(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables computed once and kept."""
    return {name: cut_lineage(table) for name, table in tables.items()}


def diff(left: dict[str, DataFrame], right: dict[str, DataFrame]) -> DataFrame:
    """Per table, the rows only the left and only the right side has. The tables should be stored ones: they are read
    once a level of digests, and again only if they differ; their rows are never shuffled."""
    out = None
    for name, table in left.items():
        other = right[name].select(*[F.col(f.name).cast(f.dataType) for f in table.schema.fields])
        rest = changed(table, other, TABLES.get(name, table.columns))
        if rest is None:
            counts = table.sparkSession.range(1).select(
                F.lit(name).alias("table_name"), F.lit(0).cast("long").alias("missing"), F.lit(0).cast("long").alias("extra"))
        else:
            counts = rest.agg(
                F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n"))), F.lit(0)).alias("missing"),
                F.coalesce(F.sum(F.when(F.col("n") < 0, -F.col("n"))), F.lit(0)).alias("extra"),
            ).select(F.lit(name).alias("table_name"), "missing", "extra")
        out = counts if out is None else out.unionByName(counts)
    return out


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table, its rows, a sum over its numbers and the digest of all its columns, to compare replays at a glance."""
    numbers = {
        "chat_common": F.col("id") + F.col("last_generated_message_id"),
        "chat_participant": F.col("user_id") * 31 + F.col("chat_id"),
        "message": F.col("id") * 31 + F.col("owner_id") + F.char_length("content"),
        "chat_user_view": F.col("user_id") + F.coalesce("last_message_id", F.lit(0)) * 31 + F.char_length("title"),
        "unread_messages_user_view": F.col("unread_messages") * 31 + F.col("last_message_id"),
    }
    out = None
    for name, table in tables.items():
        row = table_digest(table, checksum=numbers[name]).select(
            F.lit(name).alias("table_name"), "rows", "checksum", "digest")
        out = row if out is None else out.unionByName(row)
    return out
