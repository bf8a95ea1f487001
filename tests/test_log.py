"""The log as files: export, import, validation, appends and redelivery."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from chatledger import schemas as S
from chatledger.operators import events as E
from chatledger.operators.progress import consumer_lag, is_caught_up
from chatledger.sources import log as L
from tests.fold import event, frame

BIG = 9007199254740993


def line(**changes) -> str:
    record = {"metadata": {"offset": 1, "partition": 2}, "headers": {"name": "chatDeleted"}, "key": "7", "value": {"chatId": 7}}
    record.update(changes)
    return json.dumps({k: v for k, v in record.items() if v is not ...})


GOOD = [
    line(), line(value={"chatId": BIG}), line(value={"content": "x" * 100_000}), line(headers={}), line(headers=...),
    line(value={"content": 'tricky "], \\u0041 {[('}),
]
BAD = [
    ("not json", L.NOT_JSON), ("", L.NOT_JSON), (line() + " trailing", L.NOT_JSON), (line() + line(), L.NOT_JSON),
    (line()[1:], L.NOT_JSON), (line(key=7), L.BAD_KEY), (line(key=...), L.BAD_KEY), (line(key=None), L.BAD_KEY),
    (line(metadata={"offset": 1}), L.BAD_PARTITION), (line(metadata={"partition": "2"}), L.BAD_PARTITION),
    (line(metadata={"partition": 2.5}), L.BAD_PARTITION), (line(metadata=...), L.BAD_PARTITION),
    (line(headers={"name": 5}), L.BAD_HEADER), (line(headers={"a": "b", "c": None}), L.BAD_HEADER),
]


def test_lines_are_judged_one_by_one(spark):
    texts = [(t, None) for t in GOOD] + BAD
    lines = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "line int, value string")
    judged = {r.line: (r.ok, r.reason) for r in L.validate_lines(lines).collect()}
    assert judged == {i: (reason is None, reason) for i, (_, reason) in enumerate(texts)}
    assert L.rejected_lines(lines).count() == len(BAD)
    assert L.import_log(lines, strict=False).count() == len(GOOD)


@pytest.mark.parametrize("bad", [b for b, _ in BAD])
def test_strict_import_stops_at_a_bad_line(spark, bad):
    lines = spark.createDataFrame([(line(),), (bad,)], "value string")
    with pytest.raises(Exception, match="cannot import line"):
        L.import_log(lines).collect()


@pytest.mark.parametrize("look", [lambda df: df.count(), lambda df: df.select("key").collect()])
def test_strict_import_cannot_be_pruned_away(spark, look):
    lines = spark.createDataFrame([(line(),), (line() + ', "end"] junk',)], "value string")
    with pytest.raises(Exception, match="cannot import line"):
        look(L.import_log(lines))


def test_import_goes_on_where_the_log_ends(spark):
    texts = [line(metadata={"partition": p}, key=f"k{i}", headers={"name": "n", "log_seq": str(i)}) for i, p in
             enumerate([0, 1, 0, 0, 1])]
    lines = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(texts)], "file string, line long, value string")
    log = spark.createDataFrame([(0, o, "old", {"log_seq": str(o)}, "{}") for o in range(3)], S.RECORD)
    added = L.import_append(lines, log).collect()
    assert sorted((r.partition, r.offset, r.key, r.headers["log_seq"]) for r in added) == [
        (0, 3, "k0", "3"), (0, 4, "k2", "5"), (0, 5, "k3", "6"), (1, 0, "k1", "4"), (1, 1, "k4", "7")]
    alone = L.import_append(lines, log.limit(0)).collect()
    assert sorted((r.partition, r.offset, r.key) for r in alone)[:2] == [(0, 0, "k0"), (0, 1, "k2")]


VALUES = [
    ("messageCreated", '{"chatId":1,"id":"abc"}', None), ("chatPinned", '{"chatId":1,"pinned":"yes"}', None),
    ("chatPinned", '{"chatId":1} tail', None), ("chatPinned", '{"chatId":1}, "end"] tail', None), ("chatPinned", "[]", None),
    ("chatPinned", '{"chatId":1.5}', None), ("chatDeleted", '{"chatId":1,"additionalData":{"createdAt":"soon"}}', None),
    ("chatViewRefreshed", '{"chatId":1,"lastMessageAction":70000}', None),
    ("chatPinned", '{"chatId":1,"participantId":2}', (1, 2, False, None, None)),
    ("chatPinned", '{"chatId":null,"pinned":true,"content":5}', (0, 0, True, None, None)),
    ("messageCreated", '{"chatId":1}', (1, None, None, 0, "")), ("messageCreated", '{"chatId":1,"id":-7,"x":[]}', (1, None, None, -7, "")),
]


def test_values_are_read_as_their_types(spark):
    rows = [(0, i, "1", {"name": n, "log_seq": str(i)}, v) for i, (n, v, _) in enumerate(VALUES)]
    twice = spark.createDataFrame(rows + rows, S.RECORD)
    known, dead = E.read_events(twice)
    got = {r.offset: (r.chat_id, r.participant_id, r.pinned, r.message_id, r.content) for r in known.collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(VALUES) if want}
    assert sorted((r.offset, r.reason) for r in dead.collect()) == [
        (i, E.BROKEN_VALUE) for i, (_, _, want) in enumerate(VALUES) if not want]


def test_an_unstamped_log_has_positions(spark):
    rows = [(p, o, "1", {"name": "chatDeleted"}, '{"chatId":1}') for p in range(3) for o in range(2)]
    known, dead = E.read_events(spark.createDataFrame(rows, S.RECORD), partitions=3)
    assert sorted(r.log_seq for r in known.collect()) == list(range(6)) and dead.count() == 0


def test_round_trip_keeps_everything(spark, tmp_path):
    values = [json.dumps({"chatId": BIG}), json.dumps({"content": 'q"uo\n]te', "n": [1, None]}), "{}"]
    records = spark.createDataFrame(
        [(i % 2, i, f"k{i}", {"name": "n", "h": "ä"}, v) for i, v in enumerate(values)], S.RECORD
    )
    L.write_export(records, f"{tmp_path}/out")
    back = L.import_log(L.read_lines(spark, f"{tmp_path}/out"))
    shape = lambda df: {
        (r.partition, r.offset, r.key, tuple(sorted(r.headers.items())), json.dumps(json.loads(r.value), sort_keys=True))
        for r in df.collect()
    }
    assert shape(back) == shape(records)
    assert str(BIG) in back.where("offset = 0").first().value


def test_export_stops_at_a_value_that_is_not_json(spark):
    records = spark.createDataFrame([(0, 0, "k", {}, "{} tail")], S.RECORD)
    with pytest.raises(Exception, match="not JSON"):
        L.export_log(records).collect()


def test_append_keeps_chats_together_and_continues(spark, skew):
    rows = [event(i, i % 11, S.CHAT_DELETED) for i in range(200)]
    first = L.append_log(frame(spark, rows).drop("partition", "offset"), 3).select(*S.EVENT_COLUMNS, "key")
    second = L.append_log(
        frame(spark, [event(i, i % 11, S.CHAT_DELETED) for i in range(200, 300)]).drop("partition", "offset"), 3,
        first_offsets=L.end_offsets(first),
    ).select(*S.EVENT_COLUMNS, "key")
    got = first.unionByName(second).orderBy("partition", "offset").collect()
    for p in {r.partition for r in got}:
        part = [r for r in got if r.partition == p]
        assert [r.offset for r in part] == list(range(len(part)))
        assert [r.log_seq for r in part] == sorted(r.log_seq for r in part)
    assert len({(r.chat_id, r.partition) for r in got}) == 11 and all(r.key == str(r.chat_id) for r in got)


def test_redelivered_records_count_once(spark):
    records = spark.createDataFrame([(0, 0, "k", {"name": "n"}, "{}")] * 3 + [(0, 1, "k", {"name": "n"}, "{}")], S.RECORD)
    assert L.dedup(records).count() == 2


def test_bounded_scan_skips_empty_partitions(spark):
    records = spark.createDataFrame([(p, o, "k", {}, "{}") for p in (0, 1) for o in range(5)], S.RECORD)
    ends = spark.createDataFrame([(0, 3), (1, 0), (2, 4)], "partition int, end_offset bigint")
    assert {(r.partition, r.offset) for r in L.bounded(records, ends).collect()} == {(0, 0), (0, 1), (0, 2)}


def test_decode_reads_clocks_with_any_zone_and_precision(spark):
    value = lambda t: json.dumps({"additionalData": {"createdAt": t}, "chatId": 1})
    records = spark.createDataFrame([
        (0, 5, "1", {"name": "chatDeleted"}, value("2024-05-01T10:00:00.123456789Z")),
        (0, 6, "1", {"name": "chatDeleted"}, value("2024-05-01T12:00:00+02:00")),
    ], S.RECORD)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        rows = E.decode(records, partitions=3).orderBy("offset").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [str(r.created_at) for r in rows] == ["2024-05-01 10:00:00.123456", "2024-05-01 10:00:00"]
    assert [r.log_seq for r in rows] == [15, 18]


def test_dead_letters(spark):
    rows = [
        event(0, 1, "chatArchived"), event(1, 1, S.CHAT_CREATED, title="x" * 513), event(2, 1, S.CHAT_CREATED, title="x" * 512),
    ]
    records = spark.createDataFrame([(0, 9, "1", {"name": S.CHAT_CREATED, "log_seq": "3"}, "{broken")], S.RECORD)
    known, dead = E.split_known(frame(spark, rows).unionByName(E.decode(records), allowMissingColumns=True))
    assert [r.log_seq for r in known.collect()] == [2]
    assert {r.log_seq: r.reason for r in dead.collect()} == {0: E.UNKNOWN_NAME, 1: E.LONG_TITLE, 3: E.BROKEN_VALUE}


@pytest.mark.parametrize("ends, commits, done", [
    ([0, 0, 0], [None, None, None], True),
    ([5, 3, 0], [5, 3, None], True),
    ([5, 3, 0], [5, 2, None], False),
    ([5, 3, 2], [5, None, None], True),
    ([5, 3, 2], [None, None, None], False),
])
def test_caught_up(spark, ends, commits, done):
    e = spark.createDataFrame(list(enumerate(ends)), "partition int, end_offset bigint")
    c = spark.createDataFrame([(p, o) for p, o in enumerate(commits) if o is not None], "partition int, committed bigint")
    assert is_caught_up(consumer_lag(e, c)).first().caught_up is done


def test_kafka_rows_become_records(spark):
    rows = spark.createDataFrame(
        [(b"7", b"{}", 1, 4, [("name", b"chatDeleted")])],
        "key binary, value binary, partition int, offset bigint, headers array<struct<key: string, value: binary>>",
    )
    r = L.from_kafka_layout(rows).select(*[F.col(c) for c in S.RECORD.fieldNames()]).first()
    assert (r.partition, r.offset, r.key, r.headers, r.value) == (1, 4, "7", {"name": "chatDeleted"}, "{}")


def test_verdict_is_judged_once(spark):
    """The filter on the verdict reads it; it does not judge every value, its time among it, once more."""
    records = spark.range(3).selectExpr(
        "0 partition", "id offset", "'1' key", "map('name', 'chatDeleted', 'log_seq', string(id)) headers", "string(id) value")
    known, _ = E.split_known(E.decode(records))
    plan = known._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("^[0-9]{4}-") == 1
