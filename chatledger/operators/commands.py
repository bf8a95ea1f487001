"""A batch of commands turned into log events.

Every command has a position ``cmd_seq`` and is judged by the state of the log before it. All guards are
as-of lookups on version tables, so commands of one chat need not be taken one after the other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatledger import schemas as S
from chatledger.functions.text import to_flag, to_id
from chatledger.operators.history import (
    chat_states, existing_at, member_changes, member_intervals, members_at, message_lives, message_versions, newest_at,
)
from chatledger.operators.ids import assign_ids
from chatledger.operators.unread import marker_history
from chatledger.plans.materialize import cut_lineage, growing
from chatledger.plans.ordered import as_of, highest, last, numbered, running, total
from chatledger.plans.skew import align_hot

# Users one event lists, unless ``expand_commands`` is given another number; longer lists take several events.
PAGE = 1_000_000

# Reasons a command is refused.
BAD_ID = "id is not a number"
NO_CHAT = "no such chat"
NO_MESSAGE = "no such message"
NOT_OWNER = "not the owner"
NO_STATE = "no read state"

ACCEPT, IGNORE, ERROR = "accept", "ignore", "error"

PAYLOAD = [
    "participant_ids", "title", "participant_id", "pinned", "message_id", "owner_id", "content",
    "unread_action", "last_message_action", "chat_common_action", "increase_on",
]


def parse(commands: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed ids, the last log position a command sees (``at``), and ``reason`` when an id is bad; and the
    log, split for hot chats in the same way as the commands."""
    typed = commands.withColumns({
        "user_id": to_id(F.col("user_text")), "chat_id": to_id(F.col("chat_text")),
        "message_id": to_id(F.col("message_text")), "at": F.col("cmd_seq") - 1,
    })
    needs_chat = F.col("kind") != "chat_create"
    needs_message = F.col("kind").isin("message_edit", "message_delete", "message_read")
    bad = F.col("user_id").isNull() | (needs_chat & F.col("chat_id").isNull()) | (
        needs_message & F.col("message_id").isNull()
    )
    typed = typed.withColumn("reason", F.when(bad, F.lit(BAD_ID)))
    return align_hot(typed, events)


def member_pages(positions: DataFrame, members: DataFrame, page: int = PAGE) -> DataFrame:
    """The members of a chat as of each position as sorted id lists, cut after every ``page`` users: one row per
    (``chat_id``, ``at``, ``page``). A position without members gets one empty list.

    Lists are built once per change of the members that is asked for, not once per position.
    """
    asked = positions.select("chat_id", "at", "hot").distinct()
    seen = cut_lineage(as_of(asked, member_changes(members), ["chat_id"], "at", "change", ["change"]), positions)
    present = members_at(seen.where("change is not null").select("chat_id", F.col("change").alias("at")), members)
    ranked = numbered(present, ["chat_id", "at"], [F.col("user_id")], "rank_")
    lists = ranked.groupBy("chat_id", F.col("at").alias("change"), F.expr(f"(rank_ - 1) div {page}").alias("page")).agg(
        F.sort_array(F.collect_list("user_id")).alias("members")
    )
    return seen.join(growing(lists), ["chat_id", "change"], "left").select(
        "chat_id", "at", F.coalesce("page", F.lit(0)).alias("page"),
        F.coalesce("members", F.array().cast("array<bigint>")).alias("members"),
    )


def emit(rows: DataFrame, slot: int, name: str, page: Column | None = None, **fields: Column) -> DataFrame:
    """One event for every row, in place ``slot`` of its command; fields that are not given are null."""
    filled = {k: F.lit(None).cast(S.EVENT[k].dataType) for k in PAYLOAD}
    filled.update({k: v.cast(S.EVENT[k].dataType) for k, v in fields.items()})
    return rows.select(
        "cmd_seq", F.lit(slot).alias("slot"), (F.lit(0) if page is None else page).cast("long").alias("page"),
        F.lit(name).alias("name"), "chat_id", "created_at", *[v.alias(k) for k, v in filled.items()],
    )


def _refresh(rows: DataFrame, slot: int, unread: int = 0, message: int = 0, common: int = 0, **fields) -> DataFrame:
    given = {"title": F.lit(""), "increase_on": F.lit(0), "owner_id": F.lit(0), **fields}
    return emit(
        rows, slot, S.CHAT_VIEW_REFRESHED, F.col("page"), participant_ids=F.col("members"),
        unread_action=F.lit(unread), last_message_action=F.lit(message), chat_common_action=F.lit(common), **given,
    )


def _with_members(rows: DataFrame, events: DataFrame, page: int) -> DataFrame:
    members = cut_lineage(member_intervals(events), events)
    return rows.join(growing(member_pages(rows, members, page)), ["chat_id", "at"])


def with_caller() -> Column:
    """The given users, and the caller if not among them."""
    listed = F.coalesce("participant_ids", F.array().cast("array<bigint>"))
    return F.when(F.array_contains(listed, F.col("user_id")), listed).otherwise(F.array_append(listed, F.col("user_id")))


def create_chats(rows: DataFrame, events: DataFrame, base: int | DataFrame | None = None) -> DataFrame:
    """New chats with the next ids; the caller joins the list when missing. ``base`` is the last chat id
    used, by default the largest the log ever created."""
    if base is None:
        base = events.where(F.col("name") == S.CHAT_CREATED).agg(F.coalesce(F.max("chat_id"), F.lit(0)).alias("mark"))
    rows = assign_ids(rows.drop("chat_id"), base).withColumnRenamed("new_id", "chat_id")
    return emit(rows, 0, S.CHAT_CREATED, title=F.col("title")).unionByName(
        emit(rows, 1, S.PARTICIPANTS_ADDED, participant_ids=with_caller())
    )


def edit_chats(rows: DataFrame, events: DataFrame, page: int = PAGE) -> DataFrame:
    """New title, new members if any are given, and a refresh for the members before the command."""
    adding = rows.where(F.coalesce(F.size("participant_ids"), F.lit(0)) > 0)
    return emit(rows, 0, S.CHAT_EDITED, title=F.col("title")).unionByName(
        emit(adding, 1, S.PARTICIPANTS_ADDED, participant_ids=F.col("participant_ids"))
    ).unionByName(_refresh(_with_members(rows, events, page), 2, common=S.CHAT_COMMON_REFRESH, title=F.col("title")))


def delete_chats(rows: DataFrame, events: DataFrame, page: int = PAGE) -> DataFrame:
    """The deletion and the removal of all members."""
    return emit(rows, 0, S.CHAT_DELETED).unionByName(emit(
        _with_members(rows, events, page), 1, S.PARTICIPANT_DELETED, F.col("page"), participant_ids=F.col("members")
    ))


def change_participants(rows: DataFrame) -> DataFrame:
    """Adds and removals as they are, unchecked."""
    ids = F.col("participant_ids")
    return emit(rows.where(F.col("kind") == "participant_add"), 0, S.PARTICIPANTS_ADDED, participant_ids=ids).unionByName(
        emit(rows.where(F.col("kind") == "participant_delete"), 0, S.PARTICIPANT_DELETED, participant_ids=ids)
    )


def pin_chats(rows: DataFrame) -> DataFrame:
    """The caller's flag; a text that is no boolean means false."""
    return emit(rows, 0, S.CHAT_PINNED, participant_id=F.col("user_id"), pinned=to_flag(F.col("pin_text")))


def judge_posts(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Posts with their message id: one above the largest the chat ever had in the log, and one more for each accepted
    post of the batch since the log's last message. A missing chat refuses a post, which then takes no id."""
    known = as_of(rows, chat_states(events), ["chat_id"], "at", "log_seq", ["alive"])
    known = cut_lineage(known.withColumn("reason", F.when(~F.coalesce("alive", F.lit(False)), F.lit(NO_CHAT))), events)
    created = events.where(F.col("name") == S.MESSAGE_CREATED).select(
        "chat_id", F.col("log_seq").alias("at"), "hot", F.col("message_id").alias("used"), F.lit(False).alias("asked")
    )
    line = created.unionByName(known.select(
        "chat_id", "at", "hot", "cmd_seq", F.lit(True).alias("asked"), F.col("reason").isNull().cast("int").alias("one")
    ), allowMissingColumns=True)
    order = ["at", "asked", "cmd_seq"]
    counted = running(line, ["chat_id"], order, mark=highest(F.col("used")), so_far=total(F.col("one")))
    counted = running(counted, ["chat_id"], order, then=last(F.when(~F.col("asked"), F.coalesce("so_far", F.lit(0)))))
    number = F.coalesce("mark", F.lit(0)) + F.col("so_far") - F.coalesce("then", F.lit(0))
    ids = counted.where("asked").select("cmd_seq", number.cast("long").alias("message_id"))
    return known.drop("message_id").join(growing(ids), "cmd_seq").withColumn(
        "message_id", F.when(F.col("reason").isNull(), F.col("message_id")))


def judge_changes(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Edits and deletions of messages: allowed only to the owner of a message that exists; ``newest`` is
    the chat's newest message."""
    versions = message_versions(events).select(
        "chat_id", F.col("id").alias("message_id"), "hot", F.col("owner_id").alias("true_owner"), "from_seq", "to_seq"
    )
    judged = as_of(rows, versions, ["chat_id", "message_id"], "at", "from_seq", ["true_owner", "to_seq"])
    judged = judged.withColumn("true_owner", F.when(F.col("at") < F.col("to_seq"), F.col("true_owner"))).drop("to_seq")
    judged = judged.withColumn(
        "reason", F.when(F.col("true_owner").isNull(), F.lit(NO_MESSAGE))
        .when(F.col("true_owner") != F.col("user_id"), F.lit(NOT_OWNER))
    )
    lives = cut_lineage(message_lives(events), events)
    return judged.join(growing(newest_at(rows, lives).drop("hot")), ["chat_id", "at"])


def post_messages(judged: DataFrame, events: DataFrame, page: int = PAGE) -> DataFrame:
    """The message, and for all members a counter increase and a refreshed last message."""
    rows = judged.where("reason is null")
    return emit(
        rows, 0, S.MESSAGE_CREATED, message_id=F.col("message_id"), owner_id=F.col("user_id"), content=F.col("content")
    ).unionByName(_refresh(
        _with_members(rows, events, page), 1, unread=S.UNREAD_INCREASE, message=S.LAST_MESSAGE_REFRESH,
        increase_on=F.lit(1), owner_id=F.col("user_id"),
    ))


def edit_messages(judged: DataFrame, events: DataFrame, page: int = PAGE) -> DataFrame:
    """The new content, and a refreshed last message if it is the newest."""
    rows = judged.where("reason is null")
    return emit(
        rows, 0, S.MESSAGE_EDITED, message_id=F.col("message_id"), content=F.col("content")
    ).unionByName(_refresh(
        _with_members(rows.where("newest = message_id"), events, page), 1, message=S.LAST_MESSAGE_REFRESH
    ))


def delete_messages(judged: DataFrame, events: DataFrame, page: int = PAGE) -> DataFrame:
    """The deletion, and for all members a recount and a refreshed last message."""
    rows = judged.where("reason is null")
    return emit(rows, 0, S.MESSAGE_DELETED, message_id=F.col("message_id")).unionByName(_refresh(
        _with_members(rows, events, page), 1, unread=S.UNREAD_REFRESH, message=S.LAST_MESSAGE_REFRESH,
        owner_id=F.col("user_id"),
    ))


def admit_reads(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Read commands with the message clamped to the chat's newest and the decision: accepted when it moves
    an existing marker forward or the marker is still 0, an error without a marker row or any message."""
    lives = cut_lineage(message_lives(events), events)
    marks = as_of(rows, marker_history(events, lives), ["user_id", "chat_id"], "at", "log_seq", ["value"])
    keys = marks.select("cmd_seq", "chat_id", "at", "hot", F.coalesce("value", F.lit(0)).alias("id"))
    known = existing_at(keys, lives, "marker_exists").select("cmd_seq", "marker_exists")
    judged = marks.join(growing(known), "cmd_seq").join(growing(newest_at(rows, lives).drop("hot")), ["chat_id", "at"])
    clamped = F.when(F.col("newest").isNotNull(), F.least("message_id", "newest"))
    judged = judged.withColumn("clamped", clamped)
    moves = F.when(F.col("marker_exists"), F.col("clamped") > F.col("value")).otherwise(F.col("value") == 0)
    return judged.withColumn(
        "decision", F.when(F.col("value").isNull() | F.col("newest").isNull(), ERROR).when(moves, ACCEPT).otherwise(IGNORE)
    ).withColumn("reason", F.when(F.col("decision") == ERROR, F.lit(NO_STATE)))


def read_messages(judged: DataFrame) -> DataFrame:
    """Events of the accepted reads."""
    return emit(
        judged.where(F.col("decision") == ACCEPT), 0, S.MESSAGE_READED,
        participant_id=F.col("user_id"), message_id=F.col("clamped"),
    )


def expand_commands(commands: DataFrame, events: DataFrame, page: int = PAGE) -> tuple[DataFrame, DataFrame]:
    """Events of a command batch in order of (``cmd_seq``, ``slot``, ``page``), and the refused commands
    with the reason. Ignored reads are in neither. An event lists ``page`` members at most."""
    typed, events = parse(commands, events)
    typed = cut_lineage(typed, events)
    good = typed.where("reason is null")
    of: Callable[..., DataFrame] = lambda *kinds: good.where(F.col("kind").isin(*kinds))
    posted = cut_lineage(judge_posts(of("message_create"), events), events)
    edited = cut_lineage(judge_changes(of("message_edit"), events), events)
    deleted = cut_lineage(judge_changes(of("message_delete"), events), events)
    read = cut_lineage(admit_reads(of("message_read"), events), events)
    parts = [
        create_chats(of("chat_create"), events), edit_chats(of("chat_edit"), events, page),
        delete_chats(of("chat_delete"), events, page), change_participants(of("participant_add", "participant_delete")),
        pin_chats(of("chat_pin")), post_messages(posted, events, page), edit_messages(edited, events, page),
        delete_messages(deleted, events, page), read_messages(read),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    refused = typed.where("reason is not null").select("cmd_seq", "kind", "reason")
    for judged in (posted, edited, deleted, read):
        refused = refused.unionByName(judged.where("reason is not null").select("cmd_seq", "kind", "reason"))
    return out, refused


def number_events(expanded: DataFrame, events: DataFrame) -> DataFrame:
    """Log positions for expanded commands, in their order, right behind the log's last one and without gaps, ready for
    ``append_log``. Commands of the next batch must come after the positions given here."""
    last_seq = events.agg(F.coalesce(F.max("log_seq"), F.lit(-1)).alias("last")).scalar()
    placed = numbered(expanded, [], [F.col("cmd_seq"), F.col("slot"), F.col("page")], "place_")
    return placed.withColumn("log_seq", last_seq + F.col("place_")).drop("cmd_seq", "slot", "page", "place_")
