"""Version tables: what existed, and with which value, at every position of the log.

All intervals are ``[from_seq, to_seq)`` of log positions; an open end is ``schemas.OPEN``. A lookup
"as of position p" sees everything applied up to and including p.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatledger import schemas as S
from chatledger.functions.dyadic import cover, levels, ones, path, zeros
from chatledger.plans.materialize import growing
from chatledger.plans.ordered import as_of, following, highest, last, previous, running, total


def users_of(events: DataFrame, *columns: str) -> DataFrame:
    """One row per listed user of an event; a user listed twice counts once, a null list has nobody."""
    return events.select(
        "chat_id", "log_seq", "hot", *columns, F.explode(F.array_distinct("participant_ids")).alias("user_id")
    )


def fan_out(events: DataFrame) -> DataFrame:
    """The users every event addresses."""
    return users_of(events.where("participant_ids is not null")).select("log_seq", "chat_id", "user_id")


def intervals(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lives of a key from rows with ``log_seq`` and the boolean ``begins``: a life starts at a begin
    while there is none, and ends at the next end. All lives are kept."""
    rows = running(rows, keys, ["log_seq"], alive_=previous(F.col("begins")))
    alive = F.coalesce("alive_", F.lit(False))
    edges = rows.where(F.col("begins") != alive)
    edges = running(edges, keys, ["log_seq"], next_=following(F.col("log_seq")))
    return edges.where("begins").select(
        *keys, F.col("log_seq").alias("from_seq"), F.coalesce("next_", F.lit(S.OPEN)).alias("to_seq"), "hot"
    )


def _kinds(events: DataFrame, begin: str, end: str, *columns: str | Column) -> DataFrame:
    return events.where(F.col("name").isin(begin, end)).select(
        "chat_id", "log_seq", "hot", *columns, (F.col("name") == begin).alias("begins")
    )


def chat_lives(events: DataFrame) -> DataFrame:
    """When each chat existed."""
    return intervals(_kinds(events, S.CHAT_CREATED, S.CHAT_DELETED), ["chat_id"])


def message_lives(events: DataFrame) -> DataFrame:
    """When each message existed; an id may live more than once."""
    rows = _kinds(events, S.MESSAGE_CREATED, S.MESSAGE_DELETED, F.col("message_id").alias("id"))
    return intervals(rows, ["chat_id", "id"])


def message_versions(events: DataFrame) -> DataFrame:
    """Owner and content of each message over time. Edits of a message that does not exist are void."""
    rows = events.where(F.col("name").isin(S.MESSAGE_CREATED, S.MESSAGE_EDITED, S.MESSAGE_DELETED)).select(
        "chat_id", F.col("message_id").alias("id"), "log_seq", "hot", "name", "content", "owner_id"
    )
    created, deleted = F.col("name") == S.MESSAGE_CREATED, F.col("name") == S.MESSAGE_DELETED
    rows = running(
        rows, ["chat_id", "id"], ["log_seq"],
        alive_=last(F.when(created, True).when(deleted, False)), owner_=last(F.when(created, F.col("owner_id"))),
    ).where(deleted | F.col("alive_"))
    rows = running(rows, ["chat_id", "id"], ["log_seq"], next_=following(F.col("log_seq")))
    return rows.where(~deleted).select(
        "chat_id", "id", F.col("owner_").alias("owner_id"), "content", F.col("log_seq").alias("from_seq"),
        F.coalesce("next_", F.lit(S.OPEN)).alias("to_seq"), "hot",
    )


def chat_states(events: DataFrame) -> DataFrame:
    """After each create, edit or delete of a chat: does it exist, and with which title."""
    rows = events.where(F.col("name").isin(S.CHAT_CREATED, S.CHAT_EDITED, S.CHAT_DELETED))
    return running(
        rows.select("chat_id", "log_seq", "hot", "name", "title"), ["chat_id"], ["log_seq"],
        alive=last(F.when(F.col("name") == S.CHAT_CREATED, True).when(F.col("name") == S.CHAT_DELETED, False)),
        current=last(F.col("title")),
    ).select("chat_id", "log_seq", "hot", F.coalesce("alive", F.lit(False)).alias("alive"),
             F.col("current").alias("chat_title"))


def judged_adds(events: DataFrame) -> DataFrame:
    """Each ``participantsAdded`` with the state of its chat at that position: ``alive`` says whether it
    counts, ``chat_title`` is the title its members get."""
    adds = events.where(F.col("name") == S.PARTICIPANTS_ADDED).select(
        "chat_id", "log_seq", "hot", "participant_ids", "created_at"
    )
    known = as_of(adds, chat_states(events), ["chat_id"], "log_seq", "log_seq", ["alive", "chat_title"])
    return known.withColumn("alive", F.coalesce("alive", F.lit(False)))


def valid_adds(events: DataFrame) -> DataFrame:
    """Adds to a chat that exists at that position."""
    return judged_adds(events).where("alive").drop("alive")


def skipped_adds(events: DataFrame) -> DataFrame:
    """Users of adds that are void because the chat does not exist at that position."""
    return users_of(judged_adds(events).where(~F.col("alive"))).select("log_seq", "chat_id", "user_id")


def member_rows(events: DataFrame, adds: DataFrame | None = None) -> DataFrame:
    """Joins and leaves, one row per user."""
    adds = valid_adds(events) if adds is None else adds
    joins = users_of(adds).withColumn("begins", F.lit(True))
    leaves = users_of(events.where(F.col("name") == S.PARTICIPANT_DELETED)).withColumn("begins", F.lit(False))
    return joins.unionByName(leaves)


def member_intervals(events: DataFrame) -> DataFrame:
    """When each user was a member of each chat."""
    return intervals(member_rows(events), ["user_id", "chat_id"])


def member_changes(members: DataFrame) -> DataFrame:
    """The positions at which a chat's members change (``chat_id``, ``hot``, ``change``)."""
    edges = members.select("chat_id", "hot", F.explode(F.array("from_seq", "to_seq")).alias("change"))
    return edges.where(F.col("change") < S.OPEN).distinct()


def members_at(positions: DataFrame, members: DataFrame) -> DataFrame:
    """Members of a chat as of given positions (``chat_id``, ``at``): one row per position and user.

    Memberships are cut into power-of-two blocks of log positions and met by equality, so only pairs
    that really match are ever formed.
    """
    # Open memberships meet every later position; their end is the last position asked for.
    horizon = positions.agg((F.max("at") + 1).alias("end")).scalar()
    bounded = members.withColumn("end_", F.least("to_seq", horizon)).where("from_seq < end_")
    blocks = bounded.select(
        "chat_id", "user_id", F.explode(cover("from_seq", "end_")).alias("b")
    ).select("chat_id", "user_id", "b.level", "b.node")
    top = bounded.agg(F.max(levels("from_seq", "end_"))).scalar()
    points = positions.select("chat_id", "at").distinct().withColumn("top_", top).select(
        "chat_id", "at", F.explode(path("at", "top_")).alias("b")
    ).select("chat_id", "at", "b.level", "b.node")
    return points.join(growing(blocks), ["chat_id", "level", "node"]).select("chat_id", "at", "user_id")


def newest_at(positions: DataFrame, lives: DataFrame) -> DataFrame:
    """The largest id of the messages that exist in a chat as of given positions: adds ``newest``, null
    when there is none. ``positions`` has ``chat_id``, ``at`` and ``hot``; the result is distinct.

    Messages that are never deleted give a running maximum. Deleted ones matter only if they were above
    it when they appeared; these are cut into blocks, reduced to the maximum per block, and met by equality. Positions
    at which no such message exists, by a running count, meet none.
    """
    positions = positions.select("chat_id", "at", "hot").distinct()
    passes = F.col("to_seq") < S.OPEN
    line = lives.select(
        "chat_id", F.col("from_seq").alias("at"), "hot", "id", "to_seq", F.lit(False).alias("asked"),
        passes.cast("int").alias("step"),
    ).unionByName(
        lives.where(passes).select("chat_id", F.col("to_seq").alias("at"), "hot", F.lit(False).alias("asked"), F.lit(-1).alias("step")),
        allowMissingColumns=True,
    ).unionByName(positions.withColumn("asked", F.lit(True)), allowMissingColumns=True)
    line = running(
        line, ["chat_id"], ["at", "asked"], stays=highest(F.when(F.col("to_seq") == S.OPEN, F.col("id"))),
        passing_=total(F.col("step")),
    )
    above = F.col("stays").isNull() | (F.col("id") > F.col("stays"))
    blocks = line.where(~F.col("asked") & (F.col("to_seq") < S.OPEN) & above).select(
        "chat_id", "id", F.explode(cover("at", "to_seq")).alias("b")
    ).groupBy("chat_id", "b.level", "b.node").agg(F.max("id").alias("passing"))
    asked = line.where("asked").select("chat_id", "at", "hot", "stays", "passing_")
    # The longest life bounds the levels; taken from the lives, so the ordered pass runs once.
    top = lives.where(F.col("to_seq") < S.OPEN).agg(F.max(levels("from_seq", "to_seq"))).scalar()
    met = asked.where("passing_ > 0").withColumn("top_", top).select("chat_id", "at", F.explode(path("at", "top_")).alias("b")).select(
        "chat_id", "at", "b.level", "b.node"
    ).join(growing(blocks), ["chat_id", "level", "node"]).groupBy("chat_id", "at").agg(F.max("passing").alias("passing"))
    return asked.join(growing(met), ["chat_id", "at"], "left").select(
        "chat_id", "at", "hot", F.greatest("stays", "passing").alias("newest")
    )


def existing_at(keys: DataFrame, lives: DataFrame, name: str = "exists") -> DataFrame:
    """Does message (``chat_id``, ``id``) exist as of ``at``: adds a boolean. ``keys`` has ``hot``; keys and lives of
    one message are walked together, so many keys may ask for a message with many lives."""
    born = lives.select("chat_id", "id", "hot", F.col("from_seq").alias("from_"), F.col("to_seq").alias("to_"))
    found = as_of(keys, born, ["chat_id", "id"], "at", "from_", ["to_"])
    return found.select(*keys.columns, F.coalesce(F.col("at") < F.col("to_"), F.lit(False)).alias(name))


def count_after(marks: DataFrame, lives: DataFrame) -> DataFrame:
    """How many messages with an id above ``marker`` exist as of ``at``: adds ``n`` to the distinct
    (``chat_id``, ``at``, ``marker``, ``hot``). Ids and markers may be negative; the largest less the smallest of them
    must fit 63 bits.

    Only messages above the chat's smallest marker that live at some time it is asked for are looked at. "Above" is met by equality on the bits of the id, and "exists as of" is a running sum of +1 at the
    start and -1 at the end of each life; no marker is ever paired with the messages it counts.
    """
    marks = marks.select("chat_id", "at", "marker", "hot").distinct()
    limits = marks.groupBy("chat_id").agg(
        F.min("marker").alias("low_"), F.min("at").alias("first_"), F.max("at").alias("last_")
    )
    lives = lives.join(growing(limits), "chat_id").where("id > low_ and from_seq <= last_ and to_seq > first_")
    # Bits are those of the distance from the smallest number, 0 unless some are negative.
    base = marks.agg(F.least(F.min("marker"), F.lit(0)).alias("base")).scalar()
    lives = lives.withColumn("id", F.col("id") - base)
    births = lives.select("chat_id", F.col("from_seq").alias("at"), "hot", "id", F.lit(1).alias("step"))
    deaths = lives.where(F.col("to_seq") < S.OPEN).select(
        "chat_id", F.col("to_seq").alias("at"), "hot", "id", F.lit(-1).alias("step")
    )
    steps = births.unionByName(deaths).withColumn("b", F.explode(ones("id"))).drop("id")
    top = lives.agg((F.length(F.bin(F.max("id"))) - 1).alias("top")).scalar()
    asked = marks.withColumn("top_", top).withColumn("place_", F.col("marker") - base).withColumn(
        "b", F.explode(zeros("place_", "top_"))).drop("top_", "place_")
    line = steps.withColumn("asked", F.lit(False)).unionByName(
        asked.withColumn("asked", F.lit(True)).withColumn("step", F.lit(0)), allowMissingColumns=True
    ).select("chat_id", "at", "hot", "step", "marker", "asked", "b.level", "b.node")
    line = running(line, ["chat_id", "level", "node"], ["at", "asked"], so_far=total(F.col("step")))
    counted = line.where("asked").groupBy("chat_id", "at", "marker").agg(F.sum("so_far").alias("n"))
    return marks.join(growing(counted), ["chat_id", "at", "marker"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
