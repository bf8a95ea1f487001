"""Which chats a user was ever added to: an index beside the log, so that one user's questions read only those chats.

A user has a view row or a counter in no chat that never added them, so the index holds all that their list can show, and
chats that they have left besides; folding those chats' events decides. Every table of the library is made per chat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatledger import schemas as S
from chatledger.plans.materialize import scratch_path

#: Up to so many chats go into the scan as a list of ids; those of a user with more are joined.
MOST_LISTED = 2_000


def write_user_index(events: DataFrame, path: str | None = None) -> DataFrame:
    """``user_id`` and ``chat_id`` of every pair that an event adds, once each, ranged by user (then chat) over files.

    One user's pairs lie in a few row groups, told by their smallest and largest user; a user of very many chats spans
    files, since ranges follow both columns. Null users are left out; without events the index is empty.
    """
    spark = events.sparkSession
    path = path or scratch_path(spark, "user-index")
    added = events.where((F.col("name") == S.PARTICIPANTS_ADDED) & F.col("chat_id").isNotNull())
    pairs = added.select(F.explode(F.array_distinct("participant_ids")).alias("user_id"), "chat_id")
    pairs = pairs.where("user_id is not null").distinct()
    ranged = pairs.repartitionByRange("user_id", "chat_id").sortWithinPartitions("user_id", "chat_id")
    ranged.write.mode("append").parquet(path)
    return spark.read.schema(pairs.schema).parquet(path)


def extend_user_index(events: DataFrame, path: str) -> DataFrame:
    """The index with the pairs of further events, of which only those not yet in it are written."""
    spark = events.sparkSession
    known = spark.read.schema("user_id bigint, chat_id bigint").parquet(path)
    added = events.where((F.col("name") == S.PARTICIPANTS_ADDED) & F.col("chat_id").isNotNull())
    pairs = added.select(F.explode(F.array_distinct("participant_ids")).alias("user_id"), "chat_id")
    fresh = pairs.where("user_id is not null").distinct().join(known, ["user_id", "chat_id"], "left_anti")
    # Kept aside first: a table can't be read and appended to in one job without the risk of a retry that sees half.
    aside = scratch_path(spark, "user-index-part")
    fresh.write.parquet(aside)
    part = spark.read.schema("user_id bigint, chat_id bigint").parquet(aside)
    part.repartitionByRange("user_id", "chat_id").sortWithinPartitions("user_id", "chat_id").write.mode(
        "append").parquet(path)
    return spark.read.schema("user_id bigint, chat_id bigint").parquet(path)


def chats_of(index: DataFrame, user_id: int) -> DataFrame:
    """The chats a user was ever added to."""
    return index.where(F.col("user_id") == user_id).select("chat_id").distinct()


def events_for_user(events: DataFrame, index: DataFrame, user_id: int, *, most: int = MOST_LISTED) -> DataFrame:
    """The whole histories of the user's chats. Up to ``most`` chats are named in the scan's filter, which skips files and
    row groups of a log stored by chat; more are met by a join. The result is the same."""
    own = chats_of(index, user_id)
    few = [row.chat_id for row in own.limit(most + 1).collect()]
    if len(few) <= most:
        return events.where(F.col("chat_id").isin(few)) if few else events.limit(0)
    return events.join(own, "chat_id", "left_semi").select(*events.columns)
