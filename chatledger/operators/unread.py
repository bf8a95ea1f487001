"""Unread counters and read markers.

A user's row in a chat has a counter and a marker (the message read last). Four kinds of operations act on
it, in log order:

* *fill*: an add, or a refresh that recounts. The marker stays if its message exists; otherwise it falls
  back to nothing (add) or to the newest message (refresh). A marker of 0 stays 0. Creates a missing row.
* *read*: the marker becomes the given message, or the newest one if that does not exist. Creates a
  missing row.
* *post*: the poster's marker becomes the newest message; the counter stays.
* *bump*: everybody else's counter grows.

A fill or a read also recounts. So the counter is the number of messages above the marker at the last fill
or read, plus the bumps since then. The marker depends on its own past only through fills that find its
message deleted. Such a jump leads to a value that does not depend on the user, so jumps form a forest over
(user, chat, position); ``settle`` walks it in a number of rounds logarithmic in the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatledger import schemas as S
from chatledger.operators.history import (
    count_after, existing_at, message_lives, newest_at, users_of, valid_adds,
)
from chatledger.plans.materialize import cut_lineage, growing
from chatledger.plans.ordered import as_of, following, previous, running
from chatledger.plans.skew import span_of

ROW = ["user_id", "chat_id"]
NODE = [*ROW, "log_seq"]


def _refreshes(events: DataFrame, action: int) -> DataFrame:
    return events.where((F.col("name") == S.CHAT_VIEW_REFRESHED) & (F.col("unread_action") == action))


def fills(events: DataFrame) -> DataFrame:
    """Fills, one row per user; ``refill`` tells the refreshes from the adds."""
    adds = users_of(cut_lineage(valid_adds(events), events)).withColumn("refill", F.lit(False))
    return adds.unionByName(users_of(_refreshes(events, S.UNREAD_REFRESH)).withColumn("refill", F.lit(True)))


def reads(events: DataFrame) -> DataFrame:
    """Reads with the message given."""
    return events.where(F.col("name") == S.MESSAGE_READED).select(
        F.col("participant_id").alias("user_id"), "chat_id", "log_seq", "hot", F.col("message_id").alias("given")
    )


def posts(events: DataFrame) -> DataFrame:
    """Increases that list their owner."""
    return _refreshes(events, S.UNREAD_INCREASE).where(F.array_contains("participant_ids", F.col("owner_id"))).select(
        F.col("owner_id").alias("user_id"), "chat_id", "log_seq", "hot"
    )


def bumps(events: DataFrame) -> DataFrame:
    """Counter increases of everybody listed but the owner."""
    rows = users_of(_refreshes(events, S.UNREAD_INCREASE), "owner_id", "increase_on")
    return rows.where("user_id != owner_id").drop("owner_id")


def bumps_since(bumped: DataFrame, counted: DataFrame) -> DataFrame:
    """Per row, the sum of its bumps after ``at``. In a hot chat one row may have very many bumps, so these
    are summed per span before they meet ``at``; only the span that holds ``at`` is looked at bump by bump."""
    seq, amount = F.col("log_seq"), F.col("increase_on")
    marks = counted.select(*ROW, "at", "hot")
    few = bumped.where("not hot").drop("hot").join(growing(marks.where("not hot").drop("hot")), ROW).where(
        seq > F.col("at")
    ).groupBy(*ROW).agg(F.sum(amount).alias("bumped"))
    spans = bumped.where("hot").withColumn("span", span_of(bumped.sparkSession, "log_seq"))
    limits = marks.where("hot").withColumn("limit_", span_of(bumped.sparkSession, "at")).drop("hot")
    later = spans.groupBy(*ROW, "span").agg(F.sum(amount).alias("amount")).join(growing(limits), ROW).where("span > limit_")
    here = spans.withColumnRenamed("span", "limit_").join(growing(limits), [*ROW, "limit_"]).where(seq > F.col("at"))
    many = later.select(*ROW, "amount").unionByName(here.select(*ROW, amount.alias("amount"))).groupBy(*ROW).agg(
        F.sum("amount").alias("bumped")
    )
    return few.unionByName(many)


def normalize_reads(events: DataFrame, lives: DataFrame) -> DataFrame:
    """Each read's message, replaced by the newest one (or 0) when it does not exist at that position."""
    asked = reads(events).withColumnsRenamed({"log_seq": "at", "given": "id"})
    judged = existing_at(asked, lives)
    return judged.join(growing(newest_at(asked, lives).drop("hot")), ["chat_id", "at"]).select(
        F.col("at").alias("log_seq"), "user_id", "chat_id", F.col("id").alias("given"),
        F.when(F.col("exists"), F.col("id")).otherwise(F.coalesce("newest", F.lit(0))).alias("normalized"), "hot",
    )


def settle(nodes: DataFrame, lives: DataFrame) -> DataFrame:
    """The marker values that really came up, out of all that could.

    ``nodes`` has one row per (user, chat, position) with the ``value`` the marker takes if it changes there.
    At ``fixed`` nodes it changes for certain; at the others (fills) only if the message it points to is gone.
    Returns the nodes at which the marker changed.
    """
    nodes = cut_lineage(nodes, lives)
    known = running(nodes, ROW, ["log_seq"], reverse=True,
                    next_fixed=previous(F.when(F.col("fixed"), F.col("log_seq"))))
    # Where the message of a node is gone: after a life of it, until the next one if there is any.
    revived = running(lives, ["chat_id", "id"], ["from_seq"], revived=following(F.col("from_seq")))
    gaps = revived.where(F.col("to_seq") < S.OPEN).select(
        "chat_id", F.col("id").alias("value"), F.col("to_seq").alias("gone"),
        F.coalesce("revived", F.lit(S.OPEN)).alias("back"),
    )
    doomed = known.where("value > 0").join(growing(gaps), ["chat_id", "value"]).where("gone > log_seq").withColumn(
        "limit_", F.least("back", "next_fixed")
    ).where("gone < limit_").select(*NODE, "hot", "gone", "limit_")
    checks = nodes.where(~F.col("fixed")).select(*ROW, "hot", F.col("log_seq").alias("jump"))
    edges = as_of(doomed, checks, ROW, "gone", "jump", ["jump"], reverse=True).where("jump < limit_")
    return nodes.join(growing(walk(nodes.where("fixed").select(*NODE), edges.groupBy(*NODE).agg(F.min("jump").alias("jump")))), NODE)


def walk(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes that are reached from ``roots`` over ``edges``, at most one from each node to the position ``jump``."""
    edges, reached = cut_lineage(edges), cut_lineage(roots)
    # Round k adds all nodes up to 2^k jumps away and doubles the length of the jumps.
    while not edges.isEmpty():
        landed = reached.join(edges, NODE).select(*ROW, F.col("jump").alias("log_seq"))
        reached = cut_lineage(reached.union(landed).distinct())
        onward = edges.select(*ROW, F.col("log_seq").alias("jump"), F.col("jump").alias("further"))
        edges = cut_lineage(edges.join(onward, [*ROW, "jump"]).select(*NODE, F.col("further").alias("jump")))
    return reached


def marker_history(events: DataFrame, lives: DataFrame | None = None) -> DataFrame:
    """Every change of every read marker: ``value`` holds from ``log_seq`` on. The first row of a
    (user, chat) is where the marker row comes into being."""
    lives = cut_lineage(message_lives(events), events) if lives is None else lives
    filled = fills(events)
    given = normalize_reads(events, lives).select(*NODE, "hot", F.col("normalized").alias("value"))
    given = cut_lineage(given, events)
    first = filled.select(*NODE).unionByName(given.select(*NODE)).groupBy(*ROW).agg(F.min("log_seq").alias("first"))
    first = cut_lineage(first)
    posted = posts(events).join(growing(first), ROW).where("log_seq > first").drop("first")
    tops = newest_at(
        posted.unionByName(filled.where("refill").select(*posted.columns)).withColumnRenamed("log_seq", "at"), lives
    ).select("chat_id", F.col("at").alias("log_seq"), F.coalesce("newest", F.lit(0)).alias("top"))
    tops = cut_lineage(tops)
    posted = posted.join(growing(tops), ["chat_id", "log_seq"]).withColumnRenamed("top", "value")
    checked = filled.join(growing(first), ROW).join(growing(tops), ["chat_id", "log_seq"], "left").select(
        *NODE, "hot", (F.col("log_seq") == F.col("first")).alias("fixed"),
        F.when(F.col("refill") & (F.col("log_seq") > F.col("first")), F.col("top"))
        .otherwise(F.lit(0).cast("long")).alias("value"),
    )
    nodes = given.unionByName(posted.select(*given.columns)).withColumn("fixed", F.lit(True)).unionByName(checked)
    return settle(nodes, lives).select(*NODE, "value", "hot")


def unread(events: DataFrame, lives: DataFrame | None = None) -> DataFrame:
    """Counter and marker of every (user, chat) at the end of the log.

    Only what happened since the last certain marker before the last recount is looked at.
    """
    lives = cut_lineage(message_lives(events), events) if lives is None else lives
    seq = F.col("log_seq")
    filled, given, posted = fills(events), reads(events), posts(events)
    recounts = filled.select(*NODE, "hot").unionByName(given.select(*NODE, "hot"))
    base = cut_lineage(recounts.groupBy(*ROW, "hot").agg(
        F.min("log_seq").alias("first"), F.max("log_seq").alias("base")
    ), events)
    # The last certain marker up to the recount, and a post after it. Posts before the row existed are void;
    # no read can be that early, so if the latest move is such a post, there is none at all.
    moves = given.select(*NODE, "hot", "given").unionByName(posted.select(*NODE, "hot"), allowMissingColumns=True)
    found = as_of(base, moves.withColumn("start", seq), ROW, "base", "log_seq", ["start", "given"])
    latest = posted.groupBy(*ROW).agg(F.max("log_seq").alias("post"))
    void = F.col("start") < F.col("first")
    marks = cut_lineage(found.join(growing(latest), ROW, "left").select(
        *ROW, "hot", "base", F.when(~void, F.col("start")).alias("start"), "given",
        F.when(F.col("post") > F.col("base"), F.col("post")).alias("post"),
    ), events)
    starts = marks.where("start is not null")
    checked = cut_lineage(filled.join(growing(starts.select(*ROW, "start", "base")), ROW).where(
        (seq > F.col("start")) & (seq <= F.col("base"))
    ).select(*NODE, "hot", "refill"), events)

    asked = starts.select("chat_id", F.col("start").alias("at"), "hot").unionByName(
        marks.where("post is not null").select("chat_id", F.col("post").alias("at"), "hot")
    ).unionByName(checked.where("refill").select("chat_id", seq.alias("at"), "hot"))
    tops = cut_lineage(newest_at(asked, lives).select("chat_id", "at", F.coalesce("newest", F.lit(0)).alias("top")))
    begun = starts.select(*ROW, "hot", F.col("start").alias("at"), F.col("given").alias("id"))
    begun = existing_at(begun, lives).join(growing(tops), ["chat_id", "at"]).select(
        *ROW, F.col("at").alias("log_seq"), "hot", F.lit(True).alias("fixed"),
        F.when(F.col("exists"), F.col("id")).otherwise(F.col("top")).alias("value"),
    )
    possible = checked.join(growing(tops.withColumnRenamed("at", "log_seq")), ["chat_id", "log_seq"], "left").select(
        *NODE, "hot", F.lit(False).alias("fixed"),
        F.when(F.col("refill"), F.col("top")).otherwise(F.lit(0).cast("long")).alias("value"),
    )
    markers = settle(begun.unionByName(possible), lives).groupBy(*ROW).agg(F.max_by("value", "log_seq").alias("marker"))
    counted = cut_lineage(base.join(growing(markers), ROW, "left").select(
        *ROW, "hot", F.col("base").alias("at"), F.coalesce("marker", F.lit(0)).alias("marker")
    ), events)

    above = count_after(counted, lives).drop("hot")
    since = bumps_since(bumps(events), counted)
    moved = marks.where("post is not null").select(*ROW, F.col("post").alias("at")).join(
        growing(tops), ["chat_id", "at"]
    ).select(*ROW, F.col("top").alias("posted"))
    return (
        counted.join(growing(above), ["chat_id", "at", "marker"]).join(growing(since), ROW, "left").join(growing(moved), ROW, "left")
        .select(
            *ROW, (F.col("n") + F.coalesce("bumped", F.lit(0))).alias("unread_messages"),
            F.coalesce("posted", "marker").alias("last_message_id"),
        )
    )


def marker_status(unread_rows: DataFrame, lives: DataFrame) -> DataFrame:
    """What a fill at the end of the log would do to every marker."""
    now = lives.where(F.col("to_seq") == S.OPEN)
    newest = now.groupBy("chat_id").agg(F.max("id").alias("max_id"))
    present = now.select("chat_id", F.col("id").alias("marker"), F.lit(True).alias("present"))
    rows = unread_rows.select(*ROW, F.col("last_message_id").alias("marker"))
    joined = rows.join(present, ["chat_id", "marker"], "left").join(newest, "chat_id", "left")
    alive = F.coalesce("present", F.lit(False))
    kept = F.when(F.col("marker") <= 0, F.lit(0)).when(alive, F.col("marker"))
    return joined.select(
        *ROW, "marker", alive.alias("alive"), F.coalesce("max_id", F.lit(0)).alias("max_id"),
        F.coalesce(kept, F.lit(0)).alias("carried_add"), F.coalesce(kept, "max_id", F.lit(0)).alias("carried_refresh"),
    )
