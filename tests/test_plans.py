"""What the plans must and must not contain, and the skew-safe passes against plain windows."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chatledger.operators import commands as C
from chatledger.operators import history as H
from chatledger.operators import projections as P
from chatledger.operators import unread as U
from chatledger.plans.materialize import cut_lineage
from chatledger.plans.ordered import (
    as_of, following, highest, last, numbered, previous, running, total,
)
from chatledger.plans.skew import flag_hot, hot_chats
from chatledger.queries import store
from chatledger.sources import log as L
from chatledger.sources.tables import store_events, store_parts
from chatledger.streaming.replay import TABLES, replay_full
from tests.fold import frame
from tests.test_random_logs import random_log

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_running_equals_one_window(spark, skew):
    rows = [(i % 3, i, i * 7 % 11 if i % 4 else None) for i in range(300)]
    df = flag_hot(spark.createDataFrame(rows, "chat_id bigint, at bigint, v bigint")).cache()
    for reverse in (False, True):
        order = F.col("at").desc() if reverse else F.col("at")
        w = Window.partitionBy("chat_id").orderBy(order)
        upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
        expected = df.select(
            "chat_id", "at", F.last("v", True).over(upto).alias("a"), F.last("v", True).over(before).alias("b"),
            F.lead("at").over(w).alias("c"), F.max("v").over(upto).alias("d"),
            F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("e"),
        )
        v = F.col("v")
        actual = running(df, ["chat_id"], ["at"], reverse=reverse, a=last(v), b=previous(v), c=following(F.col("at")),
                         d=highest(v), e=total(v)).select(*expected.columns)
        assert {tuple(r) for r in actual.collect()} == {tuple(r) for r in expected.collect()}


@pytest.mark.parametrize("reverse", [False, True])
def test_as_of_equals_nearest(spark, skew, reverse):
    facts = [(i % 2, i * 5, f"f{i}") for i in range(60)]
    asked = [(c, t) for c in (0, 1) for t in range(-3, 310, 4)]
    f = flag_hot(spark.createDataFrame(facts, "chat_id bigint, at bigint, text string"))
    p = flag_hot(spark.createDataFrame(asked, "chat_id bigint, t bigint"))
    got = {(r.chat_id, r.t): r.text for r in as_of(p, f, ["chat_id"], "t", "at", ["text"], reverse=reverse).collect()}
    for c, t in asked:
        near = [x for x in facts if x[0] == c and (x[1] >= t if reverse else x[1] <= t)]
        best = (min if reverse else max)(near, key=lambda x: x[1], default=(0, 0, None))
        assert got[c, t] == best[2]


def test_numbered_spreads_one_key_over_many_blocks(spark):
    rows = [(1 if i % 5 else 2, i * 37 % 1009) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = numbered(df, ["k"], [F.col("v").desc()])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for key in (1, 2):
        ordered = sorted((v for k, v in rows if k == key), reverse=True)
        assert {(r.v, r.pos) for r in got.where(F.col("k") == key).collect()} == {(v, i + 1) for i, v in enumerate(ordered)}


def test_hot_chats_are_few(spark):
    spark.conf.set("spark.chatledger.hotRows", "50")
    try:
        df = spark.createDataFrame([(1,)] * 60 + [(2,)] * 40, "chat_id bigint")
        assert [r.chat_id for r in hot_chats(df).collect()] == [1]
    finally:
        spark.conf.unset("spark.chatledger.hotRows")


def jobs(events):
    lives = cut_lineage(H.message_lives(events), events)
    return {
        "lives": H.message_lives(events), "versions": H.message_versions(events), "adds": H.valid_adds(events),
        "members": P.members(events), "messages": P.messages(events), "chats": P.chat_common(events),
        "view": P.user_view(events, lives), "unread": U.unread(events, lives),
    }


def test_plans_have_no_pairwise_joins_and_bounded_windows(spark):
    spark.conf.set("spark.chatledger.hotRows", "10")
    try:
        events = store_events(frame(spark, random_log(8, chats=5, length=40)))
        for name, df in jobs(events).items():
            text = plan(df)
            assert "CartesianProduct" not in text and "NestedLoop" not in text, name
            for spec in re.findall(r"windowspecdefinition\((.*?specifiedwindowframe)", text):
                # Either inside a span, or over one row per span.
                assert "span_#" in spec, (name, spec)
    finally:
        spark.conf.unset("spark.chatledger.hotRows")


def test_plain_log_has_no_skew_branches_and_no_shuffle_per_chat(spark):
    events = store(spark, SF).events
    for name, df in jobs(events).items():
        assert "_kept" not in plan(df), name
    for df in (H.message_lives(events), H.message_versions(events)):
        assert "Exchange" not in plan(df)


def test_scans_are_pruned_and_filtered(spark):
    text = plan(H.chat_lives(store(spark, SF).events))
    assert re.search(r"PushedFilters: \[In\(name", text)
    assert "content" not in re.search(r"ReadSchema: (\S+)", text).group(1)


def sides(df) -> list[str]:
    """The plans below the topmost union."""
    node = df._jdf.queryExecution().executedPlan()
    while node.nodeName() != "Union":
        node = node.initialPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.children().head()
    return [node.children().apply(i).toString() for i in range(node.children().size())]


def test_one_hot_chat_leaves_the_others_their_buckets(spark):
    rows = frame(spark, random_log(9, chats=6, length=60))
    crowd = rows.where("chat_id = 2")
    spark.conf.set("spark.chatledger.hotRows", str(crowd.count() * 40))
    spark.conf.set("spark.chatledger.spanWidth", "37")
    try:
        # Chat 2 comes forty times over, in other positions; only it is hot.
        more = [crowd.withColumn("log_seq", F.col("log_seq") + 10_000 * i) for i in range(1, 40)]
        for part in more:
            rows = rows.unionByName(part)
        rows = cut_lineage(rows)
        parts = store_parts(rows)
        assert {r.chat_id for r in parts.hot.select("chat_id").distinct().collect()} == {2}
        assert parts.cold.where("chat_id = 2").isEmpty() and parts.events().count() == rows.count()
        for fold in (H.message_lives, H.message_versions, H.chat_lives):
            cold, hot = sides(parts.per_chat(fold))
            assert "Exchange" not in cold and "_kept" not in cold, fold.__name__
            assert "span_" in hot, fold.__name__
        plain = flag_hot(rows)
        apart, whole = parts.per_chat(replay_full), replay_full(plain)
        for name in TABLES:
            table = whole[name]
            assert apart[name].columns == table.columns
            assert table.exceptAll(apart[name]).isEmpty() and apart[name].exceptAll(table).isEmpty(), name
    finally:
        spark.conf.unset("spark.chatledger.hotRows")
        spark.conf.unset("spark.chatledger.spanWidth")


def test_parts_of_logs_without_hot_chats(spark):
    empty = store_parts(frame(spark, random_log(9, chats=2, length=5)).limit(0))
    assert empty.hot is None and empty.events().isEmpty() and empty.per_chat(P.messages).isEmpty()
    nobody = frame(spark, random_log(9, chats=2, length=5)).withColumn("chat_id", F.lit(None).cast("long"))
    assert store_parts(nobody).events().where("chat_id is null").count() == nobody.count()


def test_sides_that_grow_are_not_broadcast(spark):
    """Whatever the optimizer guesses: it takes exploded blocks for as small as the rows they come from."""
    events = store(spark, SF).events
    members, lives = cut_lineage(H.member_intervals(events), events), cut_lineage(H.message_lives(events), events)
    asked = events.select("chat_id", F.col("log_seq").alias("at"), "hot")
    posts = asked.withColumns({"cmd_seq": F.col("at") + 1, "message_id": F.lit(None).cast("long")})
    marks = asked.withColumn("marker", F.lit(0).cast("long"))
    for df in (H.members_at(asked, members), H.newest_at(asked, lives), H.count_after(marks, lives),
               C.judge_posts(posts, events)):
        assert "Broadcast" not in plan(df)


def test_partitions_of_the_log_are_not_gathered(spark, tmp_path):
    """The ends of a log are sent to its records, not a whole partition to one task."""
    records = store(spark, SF).records
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        added = L.import_append(L.read_lines(spark, export_of(records, str(tmp_path / "export"))), records)
        assert not re.search(r"SortMergeJoin \[partition#\d+L?\]", plan(added))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def export_of(records, path: str) -> str:
    L.write_export(records, path)
    return path


def test_lines_are_parsed_once(spark, tmp_path):
    """The filter that stops at a bad line stays above the parsing, and an export deals records before it parses them."""
    lines = L.read_lines(spark, export_of(store(spark, SF).records, str(tmp_path / "export")))
    for df in (L.import_log(lines), L.import_log(lines, strict=False), L.export_log(store(spark, SF).records)):
        tests = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
        assert tests and not any("parse" in line.lower() for line in tests)


def test_rows_of_few_keys_are_numbered_without_another_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v")).repartition(4)
        assert "SortMergeJoin" not in plan(numbered(df, ["k"], [F.col("v")]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_few_keys_are_walked_in_short_spans(spark):
    rows = spark.range(10).select(F.lit(1).alias("k"), (F.col("id") * 100).alias("at"), F.lit(True).alias("hot"))
    walked = running(rows, ["k"], ["at"], width=300, n=total(F.lit(1)))
    assert {(r.at, r.n) for r in walked.collect()} == {(100 * i, i + 1) for i in range(10)}
    assert "div 300" in plan(walked)
    placed = L.append_log(store(spark, SF).events.drop("partition", "offset", "hot"), 3, partitioner=L.remainder_partition)
    assert f"div {1 << 18}" in plan(placed)


def test_records_without_copies_are_not_shuffled(spark):
    records = store(spark, SF).records
    assert "Exchange" not in plan(L.dedup(records))
    again = L.dedup(records.unionByName(records.where("offset % 3 = 0")))
    assert again.count() == records.count() == again.select("partition", "offset").distinct().count()


def test_positions_without_a_passing_message_meet_no_blocks(spark, skew):
    """Message 2 lives from 20 to 40 above 1, which stays; message 3 lives from 50 to 60."""
    rows = [(1, 1, 10, 2**63 - 1), (1, 2, 20, 40), (1, 3, 50, 60)]
    lives = spark.createDataFrame(rows, "chat_id bigint, id bigint, from_seq bigint, to_seq bigint").withColumn("hot", F.lit(skew == "hot"))
    asked = spark.createDataFrame([(1, at) for at in range(0, 70, 5)], "chat_id bigint, at bigint").withColumn("hot", F.lit(skew == "hot"))
    found = H.newest_at(asked, lives)
    expected = {at: (2 if 20 <= at < 40 else 3 if 50 <= at < 60 else 1 if at >= 10 else None) for at in range(0, 70, 5)}
    assert {r.at: r.newest for r in found.collect()} == expected
    assert "passing_" in plan(found)
