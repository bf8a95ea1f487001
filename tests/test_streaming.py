"""The incremental refresh equals a full replay after every batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatledger import schemas as S
from chatledger.operators.events import decode, split_known
from chatledger.plans.skew import flag_hot
from chatledger.sources.chat_activity import as_records
from chatledger.sources.log import append_log, dedup
from chatledger.streaming import refresh
from chatledger.streaming.refresh import apply_batch, read_log, read_table, refresh_available, reset
from chatledger.streaming.replay import TABLES, diff, replay_full, stored
from tests.fold import event, frame
from tests.test_random_logs import random_log

SAME = {name: (0, 0) for name in TABLES}


def differences(spark, root: str, records) -> dict:
    events = flag_hot(split_known(decode(dedup(records)))[0])
    fresh = {name: read_table(spark, root, name) for name in TABLES}
    return {r.table_name: (r.missing, r.extra) for r in diff(stored(replay_full(events)), fresh).collect()}


def test_refresh_equals_replay(spark, tmp_path):
    rows = random_log(7, chats=6, length=40)
    # The last chat loses everything in the second half, so one bucket of every table becomes empty.
    late = [event(1000, 6, S.MESSAGE_DELETED, message_id=1), event(1001, 6, S.CHAT_DELETED),
            event(1002, 6, S.PARTICIPANT_DELETED, participant_ids=[1])]
    early = [event(-3, 6, S.CHAT_CREATED, title="gone"), event(-2, 6, S.PARTICIPANTS_ADDED, participant_ids=[1]),
             event(-1, 6, S.MESSAGE_CREATED, message_id=1, owner_id=1, content="m")]
    for r in rows + late + early:
        r["log_seq"] += 3
    everything = frame(spark, rows + early + late + [event(5000, 1, "chatArchived")])
    records = as_records(append_log(everything.drop("partition", "offset"), 3)).cache()
    position = decode(records).select("partition", "offset", "log_seq")
    placed = records.join(position, ["partition", "offset"]).cache()
    root, source = f"{tmp_path}/state", f"{tmp_path}/source"

    first = placed.where("log_seq < 120").select(*records.columns)
    first.write.parquet(source)
    refresh_available(spark, source, root, buckets=5)
    assert differences(spark, root, first) == SAME
    early_messages = read_table(spark, root, "message").count()

    # The second part brings some records of the first once more.
    second = placed.where("log_seq >= 120 or log_seq % 10 = 0").select(*records.columns)
    second.write.mode("append").parquet(source)
    refresh_available(spark, source, root, buckets=5)
    assert differences(spark, root, records) == SAME
    dead = spark.read.parquet(f"{root}/dead").collect()
    assert [(r.name, r.log_seq) for r in dead] == [("chatArchived", 5000)]

    # The second batch again, as after a failure: nothing changes.
    apply_batch(second, 1, root, buckets=5)
    assert differences(spark, root, records) == SAME
    # No record is stored twice, and the version before is still there.
    assert read_log(spark, root).count() == records.count() - 1
    assert read_table(spark, root, "message", 0).count() == early_messages
    reset(spark, root)
    assert read_table(spark, root, "message").isEmpty()


def test_a_batch_is_decoded_once(spark, tmp_path, monkeypatch):
    """Events and dead letters come from one stored frame; a broken value still ends among the dead letters."""
    seen = []
    monkeypatch.setattr(refresh, "split_known", lambda rows: (seen.append(rows), split_known(rows))[1])
    rows = [event(1, 1, S.CHAT_CREATED, title="a"), event(2, 1, S.CHAT_EDITED, title="b")]
    records = as_records(append_log(frame(spark, rows).drop("partition", "offset"), 1))
    broken = records.where("offset = 0").withColumns({"offset": F.lit(5).cast("long"), "value": F.lit("{")})
    apply_batch(records.unionByName(records).unionByName(broken), 0, str(tmp_path), buckets=2)
    assert len(seen) == 1 and "from_json" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert read_log(spark, str(tmp_path)).count() == 2
    assert spark.read.parquet(f"{tmp_path}/dead").count() == 1
