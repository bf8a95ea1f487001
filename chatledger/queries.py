"""The registered queries: every operator over the chat log derived from the ``events`` table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatledger import schemas as S
from chatledger.functions.text import joined_ids
from chatledger.operators import bulk as B
from chatledger.operators import commands as C
from chatledger.operators import events as E
from chatledger.operators import history as H
from chatledger.operators import ids as I
from chatledger.operators import progress as G
from chatledger.operators import projections as P
from chatledger.operators import reads as R
from chatledger.operators import unread as U
from chatledger.plans.materialize import cut_lineage, growing, scratch_path
from chatledger.plans.ordered import numbered
from chatledger.plans.skew import flag_hot, hot_rows, inherit_hot, span_width
from chatledger.sources import log as L
from chatledger.sources.chat_activity import PARTITIONS, actions, chat_log, commands
from chatledger.sources.log_stream import as_offsets, committed_offsets, scan_partitioned, write_partitioned
from chatledger.sources.tables import Folded, Parts, store_records
from chatledger.sources.user_index import events_for_user, write_user_index
from chatledger.streaming.refresh import apply_batch, read_table, refresh_available
from chatledger.streaming.replay import TABLES, diff, replay_full, stored, summary


@dataclass(frozen=True)
class Store:
    """The derived log as stored tables: raw records, decoded events, and the actions behind both."""

    path: str
    records: DataFrame
    parts: Parts
    acts: DataFrame

    @property
    def events(self) -> DataFrame:
        return self.parts.events()


_stores: dict[tuple, Store] = {}


def store(spark: SparkSession, sf_dir: str) -> Store:
    """Derive and store the log once per application and input; all queries read the stored tables."""
    key = (spark.sparkContext.applicationId, sf_dir, hot_rows(spark), span_width(spark))
    if key not in _stores:
        path = scratch_path(spark, "log")
        chat_log(spark, sf_dir).write.parquet(path)
        records = L.scan_log(spark, path)
        _stores[key] = Store(path, records, store_records(records)[0], actions(spark, sf_dir))
    return _stores[key]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).events


def _per_chat(spark: SparkSession, sf_dir: str, fold: Callable[[DataFrame], Folded]) -> Folded:
    """A fold that works chat by chat, over ordinary and hot chats apart."""
    return store(spark, sf_dir).parts.per_chat(fold)


def _named(records: DataFrame) -> DataFrame:
    return records.select(
        L.log_position().alias("log_seq"), "partition", "offset", "key", F.col("headers")["name"].alias("name")
    )


# Log: scan, append, export, import

def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(store(spark, sf_dir).records)


def log_bounded_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    halves = L.end_offsets(s.records).withColumn("end_offset", F.expr("end_offset div 2"))
    cut = L.scan_log(spark, s.path, end_offsets=halves)
    return cut.groupBy("partition").agg(
        F.count(F.lit(1)).alias("rows"), (F.max("offset") + 1).alias("end_offset")
    )


def log_stream_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log streamed by offsets up to the middle of every partition, stopped, and gone on with from the checkpoint:
    what was committed and left at the stop, and what has arrived in the end."""
    records = store(spark, sf_dir).records
    path, out = scratch_path(spark, "partitioned"), scratch_path(spark, "streamed")
    write_partitioned(records, path)
    ends = L.end_offsets(records)
    half = as_offsets(ends.withColumn("end_offset", F.expr("end_offset div 2")))

    def run(ending: dict[int, int] | None) -> DataFrame:
        rows = scan_partitioned(spark, path, stream=True, ending=ending).select("partition", "offset")
        query = rows.writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint").trigger(
            availableNow=True).start(out)
        query.awaitTermination()
        return committed_offsets(spark, query)

    lag = G.consumer_lag(ends, run(half))
    run(None)
    arrived = spark.read.schema("partition int, offset bigint").parquet(out).groupBy("partition").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("offset").alias("offsets"))
    return lag.join(arrived, "partition")


def log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).drop("partition", "offset")
    placed = L.append_log(events, PARTITIONS, partitioner=L.remainder_partition)
    return placed.select("partition", "offset", "key", "chat_id")


def log_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = L.export_log(store(spark, sf_dir).records).select(F.parse_json("value").alias("line"))
    field = lambda path, kind: F.variant_get("line", path, kind)
    return lines.select(
        field("$.metadata.partition", "int").alias("partition"), field("$.metadata.offset", "bigint").alias("offset"),
        field("$.key", "string").alias("key"), field("$.headers.name", "string").alias("name"),
        field("$.value.chatId", "bigint").alias("chat_id"),
    )


def _imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "export")
    L.write_export(store(spark, sf_dir).records, path)
    return L.import_log(L.read_lines(spark, path))


def log_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(_imported(spark, sf_dir))


def import_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export lines of the whole log, most of them damaged in one of five ways."""
    lines = L.export_log(store(spark, sf_dir).records)
    fault = F.col("offset") % 7
    line = F.col("value")
    damaged = (
        F.when(fault == 0, F.expr("substring(value, 2)"))
        .when(fault == 1, F.regexp_replace(line, '"key":"([0-9]+)"', '"key":$1'))
        .when(fault == 2, F.regexp_replace(line, '"partition":[0-9]+', '"part":0'))
        .when(fault == 3, F.regexp_replace(line, '"partition":([0-9]+)', '"partition":"p$1"'))
        .when(fault == 4, F.regexp_replace(line, '"log_seq":"([0-9]+)"', '"log_seq":$1'))
        .otherwise(line)
    )
    judged = L.validate_lines(lines.withColumn("value", damaged))
    return judged.select("partition", "offset", "ok", "reason")


def import_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The refused lines of an exported log file by line number; every seventh line lost its first character."""
    records = store(spark, sf_dir).records
    path = scratch_path(spark, "damaged")
    lines = numbered(L.export_log(records), [], [F.col("partition"), F.col("offset")])
    spoiled = lines.withColumn("value", F.when(F.col("pos") % 7 == 0, F.expr("substring(value, 2)")).otherwise(F.col("value")))
    # A folder per partition of the log; its files follow each other by name, so that its lines have numbers of their own.
    spoiled.repartitionByRange("partition", "offset").sortWithinPartitions("partition", "offset").select("partition", "value").write.partitionBy(
        "partition").text(path)
    lines = cut_lineage(L.read_lines(spark, path)).withColumn(
        "partition", F.regexp_extract("file", "partition=([0-9]+)", 1).cast("int"))
    before = Window.partitionBy("partition").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = lines.groupBy("partition", "file").agg(F.max("line").alias("lines")).select(
        "file", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("before"))
    rejected = L.rejected_lines(lines).join(F.broadcast(files), "file")  # one row per file
    return rejected.select("partition", (F.col("before") + F.col("line")).alias("line"), "reason")


def import_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export of the log's second half imported into a log that holds the first half of every partition."""
    records = store(spark, sf_dir).records
    halves = L.end_offsets(records).select("partition", F.expr("end_offset div 2").alias("half"))
    cut = records.join(F.broadcast(halves), "partition")  # one row per partition
    first = cut.where("offset < half").drop("half")
    path = scratch_path(spark, "second-half")
    L.write_export(cut.where("offset >= half").drop("half"), path)
    added = L.import_append(L.read_lines(spark, path), first)
    return first.select("partition", "offset", "key").unionByName(added.select("partition", "offset", "key"))


def roundtrip_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "imported")
    _imported(spark, sf_dir).select(*S.RECORD.fieldNames()).write.parquet(path)
    again = store_records(L.scan_log(spark, path))[0]
    return diff(stored(_per_chat(spark, sf_dir, replay_full)), stored(again.per_chat(replay_full)))


# Decode, route, order

def events_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = E.decode(store(spark, sf_dir).records)
    return decoded.drop("broken").withColumn("participant_ids", joined_ids(F.col("participant_ids")))


def decode_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in which values have wrong types, lack fields, or are followed by more text; what becomes of each."""
    records, value = store(spark, sf_dir).records, F.col("value")
    fault = F.col("offset") % 6
    damaged = (
        F.when(fault == 0, F.regexp_replace(value, '"chatId":([0-9]+)', '"chatId":"$1"'))
        .when(fault == 1, F.concat(value, F.lit(" trailing")))
        .when(fault == 2, F.regexp_replace(value, '"(pinned|content|title|ownerId)":("[^"]*"|[a-z0-9]+),?', ""))
        .when(fault == 3, F.concat(value, F.lit(', "end"] junk')))
        .when(fault == 4, F.regexp_replace(value, '"createdAt":"[^"]*"', '"createdAt":"yesterday"'))
        .otherwise(value)
    )
    # A field at the end leaves a comma behind.
    known, dead = E.read_events(records.withColumn("value", F.regexp_replace(damaged, ",}", "}")))
    shown = ["log_seq", "name", "chat_id", "pinned", "content", "title", "owner_id"]
    return known.select(*shown, F.lit(None).cast("string").alias("reason")).unionByName(dead.select(*shown, "reason"))


def unread_after_redelivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a log in which every third record was delivered twice."""
    records = store(spark, sf_dir).records
    twice = records.unionByName(records.where("offset % 3 = 0"))
    return store_records(twice)[0].per_chat(U.unread)


def events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.route(_events(spark, sf_dir))


def events_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead letters of a log in which some events were renamed."""
    decoded = E.decode(store(spark, sf_dir).records)
    renamed = decoded.withColumn(
        "name", F.when(F.col("offset") % 5 == 0, F.concat("name", F.lit("V2"))).otherwise(F.col("name"))
    )
    return E.split_known(renamed)[1].select("log_seq", "name", "reason")


def partition_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.partition_balance(_events(spark, sf_dir))


def events_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.order_in_chat(_events(spark, sf_dir))


def log_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in which a third of the records came twice."""
    records = store(spark, sf_dir).records
    twice = records.unionByName(records.where("offset % 3 = 0"))
    before = twice.groupBy("partition").agg(F.count(F.lit(1)).alias("rows_before"))
    after = L.dedup(twice).groupBy("partition").agg(F.count(F.lit(1)).alias("rows_after"))
    return before.join(after, "partition")


def poison_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with over-long titles, users listed twice, and for every chat an owner's increase before all else."""
    events = _events(spark, sf_dir)
    ids = F.col("participant_ids")
    early = events.where(F.col("name") == S.CHAT_CREATED).groupBy("chat_id", "hot").agg((-F.min("log_seq") - 1).alias("log_seq"))
    early = early.select(
        "chat_id", "hot", "log_seq", F.lit(S.CHAT_VIEW_REFRESHED).alias("name"), F.array(F.lit(1).cast("long")).alias("participant_ids"),
        F.lit("").alias("title"), F.lit(1).cast("long").alias("owner_id"), F.lit(S.UNREAD_INCREASE).cast("smallint").alias("unread_action"),
    )
    spoiled = events.withColumns({
        "title": F.when(F.col("name") == S.CHAT_EDITED, F.repeat("title", F.lit(200))).otherwise(F.col("title")),
        "participant_ids": F.when(
            (F.col("name") == S.PARTICIPANTS_ADDED) & (F.col("chat_id") % 2 == 0), F.concat(ids, ids)
        ).otherwise(ids),
    })
    return E.poison(spoiled.unionByName(early, allowMissingColumns=True))


# Log to tables

def chat_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_chat(spark, sf_dir, H.chat_lives).drop("hot")


def chat_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_chat(spark, sf_dir, P.chat_common)


def adds_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_chat(spark, sf_dir, H.skipped_adds)


def chat_participant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_chat(spark, sf_dir, P.members)


def membership_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_chat(spark, sf_dir, H.member_intervals).drop("hot")


def pinned_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_chat(spark, sf_dir, P.pinned_chats)


def chat_user_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_chat(spark, sf_dir, P.user_view)


def last_message_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_chat(spark, sf_dir, P.last_messages)


def message_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_chat(spark, sf_dir, H.message_lives).drop("hot")


def message_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_chat(spark, sf_dir, H.message_versions).drop("hot")


def message_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_chat(spark, sf_dir, P.messages)


# Unread counters

def fanout_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_chat(spark, sf_dir, H.fan_out)


def marker_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fold(events: DataFrame) -> DataFrame:
        lives = cut_lineage(H.message_lives(events), events)
        return U.marker_status(U.unread(events, lives), lives)

    return _per_chat(spark, sf_dir, fold)


def read_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_chat(
        spark, sf_dir, lambda events: U.normalize_reads(events, cut_lineage(H.message_lives(events), events))
    ).drop("hot")


def unread_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages above every marker at the end of the log (not the stored counter)."""
    events = _events(spark, sf_dir)
    lives = cut_lineage(H.message_lives(events), events)
    markers = cut_lineage(U.unread(events, lives).select(
        "user_id", "chat_id", F.col("last_message_id").alias("marker"), F.lit(S.OPEN - 1).alias("at")
    ))
    asked = inherit_hot(markers, events)
    counted = H.count_after(asked, lives).drop("hot")
    return markers.join(counted, ["chat_id", "at", "marker"]).select("user_id", "chat_id", "marker", "n")


def unread_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_chat(spark, sf_dir, U.unread)


# Read queries

def chats_for_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of the first user who sees any chat. A user has a view row exactly where they are a member, so the members
    of all chats name the user, and view and counters are folded from the histories of that user's chats alone."""
    seen = cut_lineage(_per_chat(spark, sf_dir, P.members))
    first = seen.agg(F.min("user_id").alias("user_id")).first().user_id
    events = events_for_user(_events(spark, sf_dir), seen, first)
    lives = cut_lineage(H.message_lives(events), events)
    view, counters = cut_lineage(P.user_view(events, lives)), U.unread(events, lives)
    rows = R.chat_list(view.where(F.col("user_id") == first), counters.where(F.col("user_id") == first))
    return numbered(rows, ["user_id"], R.list_order()).select("user_id", "pos", *R.LIST_COLUMNS)


def _indexed_list(spark: SparkSession, sf_dir: str) -> tuple[int, DataFrame, DataFrame]:
    """The user who was added to the most chats, with view and counters folded from those chats alone."""
    events = _events(spark, sf_dir)
    index = write_user_index(events)
    most = index.groupBy("user_id").count().agg(F.max_by("user_id", F.struct("count", -F.col("user_id"))).alias("u"))
    user = most.first().u
    own = events_for_user(events, index, user)
    lives = cut_lineage(H.message_lives(own), own)
    return user, cut_lineage(P.user_view(own, lives)), cut_lineage(U.unread(own, lives))


def chats_for_user_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user's list through the index of users: only their chats' events are read."""
    user, view, counters = _indexed_list(spark, sf_dir)
    rows = R.chat_list(view.where(F.col("user_id") == user), counters.where(F.col("user_id") == user))
    return numbered(rows, ["user_id"], R.list_order()).select("user_id", "pos", *R.LIST_COLUMNS)


def chats_for_user_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of three chats of that list, continued after the last row of the first."""
    user, view, counters = _indexed_list(spark, sf_dir)
    first = R.chats_for_user(view, counters, user, limit=3).collect()
    after = (first[-1].pinned, first[-1].updated_timestamp, first[-1].id) if first else None
    return R.chats_for_user(view, counters, user, after=after, limit=3).select("user_id", *R.LIST_COLUMNS)


def chat_list_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    lives = cut_lineage(H.message_lives(events), events)
    rows = R.chat_list(P.user_view(events, lives), U.unread(events, lives))
    return numbered(rows, ["user_id"], R.list_order()).select("user_id", "pos", *R.LIST_COLUMNS)


def messages_of_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.messages_of(P.messages(_events(spark, sf_dir)), 1)
    return numbered(rows, [], [F.col("id").desc()]).select("pos", "id", "owner_id", "content")


def participants_of_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.participants_of(P.members(_events(spark, sf_dir)), 1)
    return numbered(rows, [], [F.col("user_id")]).select("pos", "user_id")


def participants_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(P.members(_events(spark, sf_dir)), ["chat_id"], [F.col("user_id")]).select(
        "chat_id", "pos", "user_id"
    )


def chat_title_for_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    seen = P.members(events).withColumnRenamed("chat_id", "id")
    return R.titles(seen, P.chat_common(events))


def message_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    keys = events.where(F.col("name").isin(S.MESSAGE_EDITED, S.MESSAGE_DELETED)).select(
        "chat_id", F.col("message_id").alias("id")
    )
    return R.owners(P.messages(events), keys)


def read_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return R.read_state(U.unread(events), P.messages(events))


def last_message_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return R.last_ids(P.chat_common(events), P.messages(events))


def chat_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(R.chat_ids(P.chat_common(_events(spark, sf_dir))), [], [F.col("id")]).select("pos", "id")


# Commands

def _typed(spark: SparkSession, sf_dir: str, *kinds: str) -> tuple[DataFrame, DataFrame]:
    s = store(spark, sf_dir)
    wanted = commands(s.acts).where(F.col("kind").isin(*kinds))
    typed, events = C.parse(wanted, s.events)
    return cut_lineage(typed, events).where("reason is null"), events


ACTIONS = ("owner_id", "unread_action", "last_message_action", "chat_common_action", "increase_on", "created_at")


def _shown(expanded: DataFrame, *columns: str) -> DataFrame:
    return expanded.withColumn("users", joined_ids(F.col("participant_ids"))).select(
        "cmd_seq", "slot", "name", "chat_id", *columns
    )


def cmd_chat_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(C.create_chats(*_typed(spark, sf_dir, "chat_create")), "users", "title")


def cmd_chat_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(C.edit_chats(*_typed(spark, sf_dir, "chat_edit")), "users", "title", *ACTIONS)


def cmd_chat_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(C.delete_chats(*_typed(spark, sf_dir, "chat_delete")), "users")


def cmd_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _typed(spark, sf_dir, "participant_add", "participant_delete")
    return _shown(C.change_participants(rows), "users")


def cmd_chat_pin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(C.pin_chats(_typed(spark, sf_dir, "chat_pin")[0]), "participant_id", "pinned")


def _judged(judged: DataFrame, expanded: DataFrame) -> DataFrame:
    """Every command with its verdict, and the events of the accepted ones."""
    verdicts = judged.select(
        "cmd_seq", F.when(F.col("reason").isNull(), C.ACCEPT).otherwise("reject").alias("decision"), "reason"
    )
    events = _shown(expanded, "message_id", "users", "content", *ACTIONS).drop("chat_id")
    return verdicts.join(growing(events), "cmd_seq", "left")


def cmd_message_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, events = _typed(spark, sf_dir, "message_create")
    judged = cut_lineage(C.judge_posts(rows, events), events)
    return _judged(judged, C.post_messages(judged, events))


def cmd_message_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, events = _typed(spark, sf_dir, "message_edit")
    judged = cut_lineage(C.judge_changes(rows, events), events)
    return _judged(judged, C.edit_messages(judged, events))


def cmd_message_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, events = _typed(spark, sf_dir, "message_delete")
    judged = cut_lineage(C.judge_changes(rows, events), events)
    return _judged(judged, C.delete_messages(judged, events))


def cmd_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refused commands of a batch in which every fifth command names a user, chat or message by something else than a
    number."""
    s, n = store(spark, sf_dir), F.col("cmd_seq") % 20
    spoiled = commands(s.acts).withColumns({
        "user_text": F.when(n == 0, F.concat("user_text", F.lit("x"))).otherwise(F.col("user_text")),
        "chat_text": F.when(n == 4, F.concat(F.lit(" "), "chat_text")).otherwise(F.col("chat_text")),
        "message_text": F.when(n == 8, F.concat("message_text", F.lit(".0"))).otherwise(F.col("message_text")),
    })
    typed, _ = C.parse(spoiled, s.events)
    return typed.where("reason is not null").select("cmd_seq", "kind", "reason")


def read_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = C.admit_reads(*_typed(spark, sf_dir, "message_read"))
    return judged.select("cmd_seq", "user_id", "chat_id", F.col("message_id").alias("given"), "clamped", "decision")


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All commands as a batch that starts from nothing: a create for every chat they name, in order of the chats, and
    then the commands with the chats' new ids."""
    acts = store(spark, sf_dir).acts
    chats = cut_lineage(numbered(acts.select("chat_id").distinct(), [], [F.col("chat_id")], "place"))
    block = F.expr("(chat_id - 1) div 4 * 5")
    begun = chats.select(
        F.col("place").alias("cmd_seq"), F.lit("chat_create").alias("kind"), block.cast("string").alias("user_text"),
        F.concat(F.lit("chat "), F.col("place").cast("string")).alias("title"),
        F.array(block, block + 1).alias("participant_ids"), F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("created_at"))
    places = chats.select(F.col("chat_id").cast("string").alias("chat_text"), F.col("place").cast("string").alias("new_text"))
    rest = commands(acts).join(growing(places), "chat_text", "left").withColumns({
        "chat_text": F.col("new_text"), "cmd_seq": F.col("cmd_seq") + chats.agg(F.count(F.lit(1)) + 1).scalar()}).drop("new_text")
    return cut_lineage(rest.unionByName(begun, allowMissingColumns=True))


def bulk_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every command of a batch that builds on itself does: decision, message id, and the members it addresses."""
    batch = _batch(spark, sf_dir)
    expanded, refused = B.expand_batch(batch)
    listed = F.col("name").isin(S.CHAT_VIEW_REFRESHED, S.PARTICIPANT_DELETED) & (F.col("slot") > 0)
    done = expanded.groupBy("cmd_seq").agg(
        F.max("chat_id").alias("chat_id"), F.max(F.when(F.col("slot") == 0, F.col("message_id"))).alias("message_id"),
        F.max(F.when(listed, joined_ids(F.col("participant_ids")))).alias("users"), F.count(F.lit(1)).alias("n_events"))
    decision = F.when(F.col("reason").isNotNull(), "reject").when(F.col("n_events").isNull(), C.IGNORE).otherwise(C.ACCEPT)
    return batch.select("cmd_seq", "kind").join(growing(done), "cmd_seq", "left").join(
        growing(refused.drop("kind")), "cmd_seq", "left").select(
        "cmd_seq", "kind", "chat_id", "message_id", "users", F.coalesce("n_events", F.lit(0)).alias("n_events"),
        decision.alias("decision"), "reason")


def bulk_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters and markers after the batch's events have been numbered, appended to an empty log, and replayed."""
    none = spark.createDataFrame([], S.EVENT)
    events = C.number_events(B.expand_batch(_batch(spark, sf_dir))[0], none)
    log = flag_hot(cut_lineage(L.append_log(events, PARTITIONS, partitioner=L.remainder_partition).select(*S.EVENT_COLUMNS)))
    return U.unread(log).select("user_id", "chat_id", "unread_messages", "last_message_id")


def participants_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the chat as every view refresh found them."""
    events = _events(spark, sf_dir)
    positions = events.where(F.col("name") == S.CHAT_VIEW_REFRESHED).select("chat_id", F.col("log_seq").alias("at"))
    return H.members_at(positions, cut_lineage(H.member_intervals(events), events)).select(
        F.col("at").alias("log_seq"), "chat_id", "user_id"
    )


# Ids, progress, replay

def assign_chat_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    creates = commands(s.acts).where("kind = 'chat_create'").select("cmd_seq")
    base = I.chat_id_high_water(P.chat_common(s.events))
    return I.assign_ids(creates, base).select("cmd_seq", "new_id")


def assign_message_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, events = _typed(spark, sf_dir, "message_create")
    base = I.message_id_high_water(P.chat_common(events), P.messages(events))
    return I.assign_ids(rows.select("cmd_seq", "chat_id", "hot"), base, "chat_id").select(
        "cmd_seq", "chat_id", "new_id"
    )


def chat_id_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.chat_id_high_water(P.chat_common(_events(spark, sf_dir)))


def message_id_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return I.message_id_high_water(P.chat_common(events), P.messages(events))


def consumer_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lag of a consumer that stopped three quarters into the log and never saw the last partition."""
    records = store(spark, sf_dir).records
    ends = L.end_offsets(records)
    committed = ends.where(F.col("partition") < PARTITIONS - 1).select(
        "partition", F.expr("end_offset * 3 div 4").alias("committed")
    )
    return G.consumer_lag(ends, committed)


def is_caught_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.is_caught_up(consumer_lag(spark, sf_dir))


def replay_full_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(stored(_per_chat(spark, sf_dir, replay_full)))


def replay_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log fed to the streaming refresh in two parts, compared with one full replay."""
    s = store(spark, sf_dir)
    root = scratch_path(spark, "refresh")
    middle = s.events.agg(F.expr("max(log_seq) div 2").alias("middle")).scalar()
    position = L.log_position()
    for part in (position <= middle, position > middle):
        s.records.where(part).write.mode("append").parquet(f"{root}/source")
        refresh_available(spark, f"{root}/source", root, buckets=8)
    fresh = {name: read_table(spark, root, name) for name in TABLES}
    return diff(stored(s.parts.per_chat(replay_full)), fresh)


def refresh_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and markers after four batches, each of which brings some records of the batches before once more."""
    s = store(spark, sf_dir)
    root = scratch_path(spark, "batches")
    quarter = s.events.agg(F.expr("max(log_seq) div 4 + 1").alias("quarter")).scalar()
    for number in range(4):
        part = L.log_position()
        again = (part < quarter * number) & (part % 10 == number)
        apply_batch(s.records.where((F.floor(part / quarter) == number) | again), number, root, buckets=8)
    return read_table(spark, root, "unread_messages_user_view")


Query = Callable[[SparkSession, str], DataFrame]


def _forced_hot(query: Query) -> Query:
    """The same query over a log stored with every larger chat split into short spans."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        forced = {"spark.chatledger.hotRows": "40", "spark.chatledger.spanWidth": "3000"}
        before = {k: spark.conf.get(k, None) for k in forced}
        try:
            for k, v in forced.items():
                spark.conf.set(k, v)
            return query(spark, sf_dir)
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    return run


REGISTERED: dict[str, Query] = {f.__name__: f for f in (
    log_scan, log_bounded_scan, log_stream_resumed, log_append, log_export, log_import, import_validation, import_rejects, import_append,
    roundtrip_diff, decode_damaged, unread_after_redelivery,
    events_decode, events_by_type, events_unknown, partition_balance, events_ordered, log_dedup, poison_events,
    chat_lifetimes, chat_common, adds_skipped, chat_participant, membership_intervals, pinned_chats, chat_user_view,
    last_message_view, message_lifetimes, message_versions, message_table,
    fanout_users, marker_status, read_normalized, unread_counts, unread_view,
    chats_for_user, chats_for_user_indexed, chats_for_user_page, chat_list_all, messages_of_chat, participants_of_chat, participants_all, chat_title_for_user,
    message_owner, read_state, last_message_id, chat_ids,
    cmd_chat_create, cmd_chat_edit, cmd_chat_delete, cmd_participants, cmd_chat_pin,
    cmd_message_create, cmd_message_edit, cmd_message_delete, cmd_rejects, read_admission, bulk_load, bulk_replay, participants_asof,
    assign_chat_ids, assign_message_ids, chat_id_high_water, message_id_high_water,
    consumer_lag, is_caught_up, replay_incremental, refresh_batches,
)} | {"replay_full": replay_full_tables} | {
    f"{q.__name__}_hot": _forced_hot(q) for q in (unread_view, chat_user_view, cmd_message_delete)
}
