"""The log source driven by offsets: batches, bounded runs, stop and restart, gaps, lag."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException

from chatledger import schemas as S
from chatledger.operators.events import decode
from chatledger.operators.progress import consumer_lag, is_caught_up
from chatledger.plans.skew import flag_hot
from chatledger.sources.chat_activity import as_records
from chatledger.sources.log import append_log, end_offsets
from chatledger.sources.log_stream import (
    LogFiles, LogReader, as_offsets, committed_offsets, scan_partitioned, write_partitioned,
)
from chatledger.streaming.refresh import committed, read_table, refresh_partitioned
from chatledger.streaming.replay import replay_full
from tests.fold import frame
from tests.test_random_logs import random_log


def records(spark, partition: int, first: int, end: int):
    rows = [(partition, i, str(i % 3), {"name": "chatEdited", "log_seq": str(i)} if i % 2 else None,
             None if i % 5 == 0 else f"{{\"é\": {i}}}") for i in range(first, end)]
    return spark.createDataFrame(rows, S.RECORD)


def run(spark, path: str, out: str, **options):
    query = scan_partitioned(spark, path, stream=True, **options).writeStream.format("parquet").option(
        "checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return query


def seen(spark, out: str) -> list[tuple]:
    return sorted(tuple(r) for r in spark.read.schema(S.RECORD).parquet(out).select("partition", "offset").collect())


def expected(**ends: int) -> list[tuple]:
    return [(int(p[1:]), i) for p, end in sorted(ends.items()) for i in range(end)]


def test_batch_equals_the_records(spark, tmp_path):
    path = f"{tmp_path}/log"
    log = records(spark, 0, 0, 50).unionByName(records(spark, 3, 0, 20)).cache()
    assert scan_partitioned(spark, path).isEmpty()
    write_partitioned(log, path)
    as_text = lambda df: sorted(json.dumps(r.asDict(), sort_keys=True) for r in df.collect())
    assert as_text(scan_partitioned(spark, path)) == as_text(log)
    assert as_text(scan_partitioned(spark, f"file://{path}")) == as_text(log)
    part = scan_partitioned(spark, path, starting={0: 10}, ending={0: 12})
    assert sorted(r.offset for r in part.collect()) == [10, 11]
    assert as_offsets(end_offsets(log)) == {0: 50, 3: 20}


def test_stream_stops_at_its_ends_and_goes_on(spark, tmp_path):
    path, out = f"{tmp_path}/log", f"{tmp_path}/out"
    first = records(spark, 0, 0, 50).unionByName(records(spark, 1, 0, 20)).cache()
    write_partitioned(first, path)
    query = run(spark, path, out, ending={0: 25, 1: 30})
    assert seen(spark, out) == expected(p0=25, p1=20)
    lag = consumer_lag(end_offsets(first), committed_offsets(spark, query))
    assert {r.partition: (r.committed, r.lag) for r in lag.collect()} == {0: (25, 25), 1: (20, 0)}
    assert not is_caught_up(lag).first().caught_up

    # The restart has no ends; a partition that is new to it and more of an old one come along.
    more = records(spark, 1, 20, 31).unionByName(records(spark, 7, 0, 4))
    write_partitioned(more, path)
    query = run(spark, path, out)
    assert seen(spark, out) == expected(p0=50, p1=31, p7=4)
    lag = consumer_lag(end_offsets(first.unionByName(more)), committed_offsets(spark, query))
    assert is_caught_up(lag).first().caught_up
    # Nothing new: nothing is read twice.
    run(spark, path, out)
    assert seen(spark, out) == expected(p0=50, p1=31, p7=4)


def test_gaps_hold_a_partition_until_they_are_filled(spark, tmp_path):
    path, out = f"{tmp_path}/log", f"{tmp_path}/out"
    write_partitioned(records(spark, 0, 0, 10).unionByName(records(spark, 0, 15, 20)), path + "-holes")
    write_partitioned(records(spark, 0, 0, 10), path)
    write_partitioned(records(spark, 0, 15, 20), path)
    run(spark, path, out)
    assert seen(spark, out) == expected(p0=10)
    skipped = scan_partitioned(spark, path, gaps="skip")
    assert sorted(r.offset for r in skipped.collect()) == [*range(10), *range(15, 20)]
    write_partitioned(records(spark, 0, 10, 15), path)
    run(spark, path, out)
    assert seen(spark, out) == expected(p0=20)


def test_lost_files_and_bad_layouts_stop_the_reader(spark, tmp_path):
    path = f"{tmp_path}/log"
    write_partitioned(records(spark, 0, 5, 10), path)
    reader = LogReader({"path": path})
    with pytest.raises(ValueError, match="no longer holds"):
        reader.slices({"0": 0}, {"0": 8})
    with pytest.raises(ValueError, match="hold or skip"):
        LogFiles(path, "maybe")
    spark.createDataFrame([(1, None, "k", None, "v")], S.RECORD).write.partitionBy("partition").parquet(f"{path}-null")
    with pytest.raises(PySparkException, match="without an offset"):
        scan_partitioned(spark, f"{path}-null").collect()


def test_stream_with_earlier_ends_loses_nothing(spark, tmp_path):
    path, out = f"{tmp_path}/log", f"{tmp_path}/out"
    write_partitioned(records(spark, 0, 0, 20).unionByName(records(spark, 1, 0, 5)), path)
    run(spark, path, out, ending={0: 15, 1: 5})
    run(spark, path, out, ending={0: 12})
    assert seen(spark, out) == expected(p0=15, p1=5)
    run(spark, path, out)
    again = seen(spark, out)
    assert sorted(set(again)) == expected(p0=20, p1=5) and len(again) == 25 + 3 + 5


def test_removed_files_are_told(spark, tmp_path):
    path = f"{tmp_path}/log"
    write_partitioned(records(spark, 0, 10, 20), path)
    with pytest.raises(ValueError, match="begins at 10, not at 0"):
        LogReader({"path": path}).newest()
    kept = LogReader({"path": path, "starting": '{"0": 10}'})
    assert [(s.start, s.end) for s in kept.slices({"0": 15}, kept.newest())] == [(15, 20)]


def test_slices_follow_row_groups(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/log"
    records(spark, 2, 0, 4000).repartitionByRange(1, "offset").sortWithinPartitions("offset").write.option(
        "parquet.block.size", 4096).option("parquet.page.size.row.check.min", 100).partitionBy("partition").parquet(path)
    monkeypatch.setattr("chatledger.sources.log_stream.SLICE_BYTES", 1)
    reader = LogReader({"path": path})
    whole = reader.slices({}, reader.newest())
    assert reader.newest() == {"2": 4000} and all(len(s.groups) == 1 for s in whole)
    few = reader.slices({"2": 1000}, {"2": 1001})
    assert len(few) == 1 and [b.num_rows for b in reader.rows(few[0])] == [1]


def test_refresh_by_offsets(spark, tmp_path):
    path, root = f"{tmp_path}/log", f"{tmp_path}/state"
    log = as_records(append_log(frame(spark, random_log(4, chats=4, length=20)).drop("partition", "offset"), 2)).cache()
    write_partitioned(log, path)
    assert committed(spark, root).isEmpty()
    ends = as_offsets(end_offsets(log))
    for ending in ({p: end // 2 for p, end in ends.items()}, None):
        refresh_partitioned(spark, path, root, ending=ending, buckets=3)
        upto = ending or ends
        assert {r.partition: r.committed for r in committed(spark, root).collect()} == upto
        part = log.where(" or ".join(f"(partition = {p} and offset < {end})" for p, end in upto.items()))
        want = replay_full(flag_hot(decode(part).drop("broken")))["message"]
        got = read_table(spark, root, "message").select(*want.columns)
        assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()
