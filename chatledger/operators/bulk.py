"""A batch of commands that builds on itself: bulk load without a log.

Every command sees what the commands before it did, as if each had been applied before the next one was judged. Taking
them one after the other is not needed: apart from reads, what a command does follows from the commands alone.

* Chats, adds, removals, titles and pins have no guard, so when a chat exists and who its members are is known from the
  commands: a create begins a chat's life, the first delete after it ends it and removes all its members; an add counts
  while its chat lives.
* A post takes its chat's next number if the chat lives, so message ids are running counts.
* An owner is fixed by the post, so a message dies by the first deletion *by its owner*. Changes by others, before the
  post or after the death are refused.

With posts and deaths decided, the skeleton of the log is known, and with it all member lists, newest messages and owners:
the batch is expanded against its own skeleton by the rules of ``operators.commands``. Only reads are recursive: a read is
admitted by the user's marker, which admitted reads before it moved. ``admit_chain`` decides them by pointer doubling.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatledger import schemas as S
from chatledger.functions.dyadic import ones, zeros
from chatledger.operators import commands as C
from chatledger.operators.history import existing_at, message_lives, newest_at, users_of, valid_adds
from chatledger.operators.ids import assign_ids
from chatledger.operators.unread import NODE, ROW, fills, posts, walk
from chatledger.plans.materialize import cut_lineage, growing
from chatledger.plans.ordered import as_of, previous, running
from chatledger.plans.skew import find_hot, mark_hot

#: Log positions to a command: the event in slot ``s`` of command ``c`` stands at ``SLOTS * c + s``.
SLOTS = 4


def _typed(commands: DataFrame, base: int) -> tuple[DataFrame, DataFrame | None]:
    """The commands with typed ids, their place in the log to come, and the ids of the chats they create; and the hot
    chats."""
    none = commands.sparkSession.createDataFrame([], S.EVENT).withColumn("hot", F.lit(False))
    typed, _ = C.parse(commands.withColumn("cmd_seq", F.col("cmd_seq") * SLOTS), none)
    typed = cut_lineage(typed.drop("hot"))
    fresh = assign_ids(typed.where("kind = 'chat_create' and reason is null").select("cmd_seq"), base)
    typed = typed.join(growing(fresh), "cmd_seq", "left").withColumn("chat_id", F.coalesce("new_id", "chat_id")).drop("new_id")
    typed = cut_lineage(typed)
    hot = find_hot(typed)
    return mark_hot(typed, hot), hot


def _placed(parts: list[DataFrame], hot: DataFrame | None) -> DataFrame:
    """Expanded commands as rows of a log."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    gone = {"partition": F.lit(None).cast("int"), "offset": F.lit(None).cast("long")}
    rows = out.withColumn("log_seq", F.col("cmd_seq") + F.col("slot")).withColumns(gone).select(*S.EVENT_COLUMNS)
    return mark_hot(rows, hot)


def _removed_by_deletes(chats: DataFrame) -> DataFrame:
    """The removals that deletions of chats bring, one row per user: every member joined by an add whose next deletion
    of the chat it is. Users who had left before are removed once more, which changes nothing."""
    deletes = chats.where(F.col("name") == S.CHAT_DELETED).select("chat_id", "hot", F.col("log_seq").alias("deleted"))
    joins = valid_adds(chats)
    ended = as_of(joins, deletes, ["chat_id"], "log_seq", "deleted", ["deleted"], reverse=True).where("deleted is not null")
    users = users_of(ended, "deleted").select("chat_id", "hot", "user_id", "deleted").distinct()
    given = {
        "log_seq": F.col("deleted") + 1, "name": F.lit(S.PARTICIPANT_DELETED), "chat_id": F.col("chat_id"),
        "participant_ids": F.array("user_id"),
    }
    return users.select(*[
        given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.EVENT.fields], "hot")


def first_owner_deletes(posted: DataFrame, deletes: DataFrame) -> DataFrame:
    """The deletions that take effect: of each accepted post, the first one by its owner after it."""
    post = posted.where("reason is null").select(
        "chat_id", "message_id", "user_id", F.col("cmd_seq").alias("born"))
    later = deletes.join(growing(post), ["chat_id", "message_id", "user_id"]).where("cmd_seq > born")
    return later.groupBy("chat_id", "message_id").agg(F.min("cmd_seq").alias("cmd_seq"))


def admit_chain(rows: DataFrame, log: DataFrame, lives: DataFrame) -> DataFrame:
    """Read commands with the message clamped to the chat's newest and the decision, each seeing the admitted reads before
    it. ``log`` holds all events of the batch but those of reads; ids are positive and have one life each.

    A marker that takes value ``m`` at some position moves next at the earliest of: the user's next post; the next fill
    after the death of message ``m``; and, while ``m`` lives (or for ``m`` = 0, always), the next read of a message above
    ``m``. All three follow from (user, chat, position, ``m``) alone, and what a marker moves to does not depend on where
    it was. So the moves that are possible form a forest, and those that happen are what is reached from the certain
    ones. "The next read above m" is met by equality on the bits of the ids; reads are never paired with reads.
    """
    filled = cut_lineage(fills(log), log)
    first = cut_lineage(filled.groupBy(*ROW).agg(F.min("log_seq").alias("first")))
    judged = rows.join(growing(newest_at(rows, lives).drop("hot")), ["chat_id", "at"]).join(growing(first), ROW, "left")
    judged = judged.withColumn("clamped", F.when(F.col("newest").isNotNull(), F.least("message_id", "newest")))
    able = F.col("newest").isNotNull() & F.coalesce(F.col("first") < F.col("cmd_seq"), F.lit(False))
    judged = cut_lineage(judged.withColumn("able", able), log)
    asked = judged.where("able").select(*ROW, "hot", "at", "cmd_seq", "newest", F.col("clamped").alias("id"))
    tries = existing_at(asked, lives).select(
        *ROW, "hot", F.col("cmd_seq").alias("log_seq"), F.col("id").alias("clamped"),
        F.when(F.col("exists"), F.col("id")).otherwise(F.col("newest")).alias("value"))
    tries = cut_lineage(tries, log)

    posted = posts(log).join(growing(first), ROW).where("log_seq > first").drop("first")
    again = filled.join(growing(first), ROW).where("log_seq > first").drop("first")
    tops = newest_at(
        posted.unionByName(again.where("refill").select(*posted.columns)).withColumnRenamed("log_seq", "at"), lives
    ).select("chat_id", F.col("at").alias("log_seq"), F.coalesce("newest", F.lit(0)).alias("top"))
    tops = cut_lineage(tops)
    begun = filled.join(growing(first), ROW).where("log_seq = first").select(
        *NODE, "hot", F.lit(0).cast("long").alias("value"), F.lit(True).alias("fixed"))
    moved = posted.join(growing(tops), ["chat_id", "log_seq"]).select(
        *NODE, "hot", F.col("top").alias("value"), F.lit(True).alias("fixed"))
    refilled = again.join(growing(tops), ["chat_id", "log_seq"], "left").select(
        *NODE, "hot", F.when(F.col("refill"), F.col("top")).otherwise(F.lit(0)).cast("long").alias("value"),
        F.lit(False).alias("fixed"))
    nodes = begun.unionByName(moved).unionByName(refilled).unionByName(
        tries.select(*NODE, "hot", "value", F.lit(False).alias("fixed")))
    deaths = lives.where(F.col("to_seq") < S.OPEN).select(
        "chat_id", F.col("id").alias("value"), F.col("to_seq").alias("gone"))
    nodes = running(nodes, ROW, ["log_seq"], reverse=True,
                    next_fixed=previous(F.when(F.col("fixed"), F.col("log_seq"))))
    nodes = cut_lineage(nodes.join(growing(deaths), ["chat_id", "value"], "left"), log)

    fill_at = again.select(*ROW, "hot", F.col("log_seq").alias("fill"))
    fallen = as_of(nodes.where("gone is not null").select(*NODE, "hot", "gone"), fill_at, ROW, "gone", "fill", ["fill"],
                   reverse=True).select(*NODE, F.col("fill").alias("jump"))
    after = nodes.withColumn("from_", F.col("log_seq") + 1).select(*NODE, "hot", "value", "gone", "from_")
    read_at = tries.select(*ROW, "hot", F.col("log_seq").alias("read"), "clamped")
    any_read = as_of(after.where("value <= 0"), read_at, ROW, "from_", "read", ["read"], reverse=True)
    top = tries.agg(F.greatest(F.length(F.bin(F.max("clamped"))) - 1, F.lit(0)).alias("top")).scalar()
    level = lambda df: df.select("*", "b.level", "b.node").drop("b")
    wanted = level(after.where("value > 0").withColumn("top_", top).withColumn("b", F.explode(zeros("value", "top_"))).drop("top_"))
    offered = level(read_at.where("clamped > 0").withColumn("b", F.explode(ones("clamped"))).drop("clamped"))
    above = as_of(wanted, offered, [*ROW, "level", "node"], "from_", "read", ["read"], reverse=True)
    above = above.groupBy(*NODE, "gone").agg(F.min("read").alias("read")).where("read < coalesce(gone, read + 1)")
    jumps = fallen.unionByName(any_read.select(*NODE, F.col("read").alias("jump"))).unionByName(
        above.select(*NODE, F.col("read").alias("jump"))).where("jump is not null")
    edges = jumps.groupBy(*NODE).agg(F.min("jump").alias("jump")).join(growing(nodes.select(*NODE, "next_fixed")), NODE)
    edges = edges.where("next_fixed is null or jump < next_fixed").drop("next_fixed")
    reached = walk(nodes.where("fixed").select(*NODE), edges)
    admitted = reached.withColumnRenamed("log_seq", "cmd_seq").withColumn("admitted", F.lit(True))
    decided = judged.join(growing(admitted), [*ROW, "cmd_seq"], "left")
    decision = F.when(~F.col("able"), C.ERROR).when(F.col("admitted"), C.ACCEPT).otherwise(C.IGNORE)
    return decided.withColumn("decision", decision).withColumn(
        "reason", F.when(F.col("decision") == C.ERROR, F.lit(C.NO_STATE))).drop("able", "admitted", "first")


def expand_batch(commands: DataFrame, *, base: int = 0, page: int = C.PAGE) -> tuple[DataFrame, DataFrame]:
    """Events of a batch that starts from nothing, in order of (``cmd_seq``, ``slot``, ``page``), and the refused commands
    with the reason. Chats get the ids from ``base`` + 1 on, in order of their creation, which other commands of the batch may name.
    ``number_events`` with an empty log gives the positions."""
    typed, hot = _typed(commands, base)
    typed = cut_lineage(typed, typed)
    good = typed.where("reason is null")
    of: Callable[..., DataFrame] = lambda *kinds: good.where(F.col("kind").isin(*kinds))
    emit = C.emit
    created = emit(of("chat_create"), 0, S.CHAT_CREATED, title=F.col("title")).unionByName(
        emit(of("chat_create"), 1, S.PARTICIPANTS_ADDED, participant_ids=C.with_caller()))
    renamed = of("chat_edit")
    adding = renamed.where(F.coalesce(F.size("participant_ids"), F.lit(0)) > 0)
    free = [
        created, emit(renamed, 0, S.CHAT_EDITED, title=F.col("title")),
        emit(adding, 1, S.PARTICIPANTS_ADDED, participant_ids=F.col("participant_ids")),
        emit(of("chat_delete"), 0, S.CHAT_DELETED), C.change_participants(of("participant_add", "participant_delete")),
    ]
    chats = cut_lineage(_placed(free, hot), typed)
    chats = cut_lineage(chats.unionByName(_removed_by_deletes(chats)), typed)
    posted = cut_lineage(C.judge_posts(of("message_create"), chats), typed)
    deaths = first_owner_deletes(posted, of("message_delete"))
    messages = [
        emit(posted.where("reason is null"), 0, S.MESSAGE_CREATED, message_id=F.col("message_id"),
             owner_id=F.col("user_id"), content=F.col("content")),
        emit(of("message_delete").join(growing(deaths), ["cmd_seq", "chat_id", "message_id"], "left_semi"), 0, S.MESSAGE_DELETED,
             message_id=F.col("message_id")),
    ]
    skeleton = cut_lineage(chats.unionByName(_placed(messages, hot)), typed)
    edited = cut_lineage(C.judge_changes(of("message_edit"), skeleton), typed)
    deleted = cut_lineage(C.judge_changes(of("message_delete"), skeleton), typed)
    parts = [
        created, C.edit_chats(renamed, skeleton, page), C.delete_chats(of("chat_delete"), skeleton, page),
        C.change_participants(of("participant_add", "participant_delete")), C.pin_chats(of("chat_pin")),
        C.post_messages(posted, skeleton, page), C.edit_messages(edited, skeleton, page),
        C.delete_messages(deleted, skeleton, page),
    ]
    log = cut_lineage(_placed(parts, hot), typed)
    read = cut_lineage(admit_chain(of("message_read"), log, cut_lineage(message_lives(log), log)), typed)
    out = parts[0]
    for part in [*parts[1:], C.read_messages(read)]:
        out = out.unionByName(part)
    refused = typed.where("reason is not null").select("cmd_seq", "kind", "reason")
    for judged in (posted, edited, deleted, read):
        refused = refused.unionByName(judged.where("reason is not null").select("cmd_seq", "kind", "reason"))
    unscaled = (F.col("cmd_seq") / SLOTS).cast("long")
    return out.withColumn("cmd_seq", unscaled), refused.withColumn("cmd_seq", unscaled)
