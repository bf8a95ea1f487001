"""Versioned tables and applied offsets."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from chatledger.sources.offsets import merge_offsets, without_applied
from chatledger.sources.versions import OFFSETS, Versions

ROWS = "chat_id bigint, v string, bucket int"
BUCKETS = 3


def written(spark, tables: Versions, version: int, state: dict, touched: set) -> None:
    """A version with the rows of the touched chats in ``state`` (chat -> list of values)."""
    rows = [(c, v, c % BUCKETS) for c in touched for v in state.get(c, [])]
    chats = spark.createDataFrame([(c, c % BUCKETS) for c in touched], "chat_id bigint, bucket int")
    tables.commit(version, chats, {"t": spark.createDataFrame(rows, ROWS)})


def seen(tables: Versions, version: int | None = None) -> dict:
    out: dict = {}
    for r in tables.read("t", version).collect():
        out.setdefault(r.chat_id, []).append(r.v)
    return {c: sorted(v) for c, v in out.items()}


def there(state: dict) -> dict:
    return {c: sorted(v) for c, v in state.items() if v}


def test_versions_equal_the_state_after_every_commit(spark, tmp_path):
    tables = Versions(spark, str(tmp_path), {"t": "chat_id"}, most_deltas=3, keep=2)
    assert tables.read("t") is None and tables.finished() == -1
    rnd, state, past = random.Random(2), {}, []
    for version in range(9):
        touched = {rnd.randrange(9) for _ in range(3)}
        for c in touched:
            state[c] = [f"{version}.{i}" for i in range(rnd.randint(0, 2))]
        written(spark, tables, version, state, touched)
        past.append(there(state))
        assert seen(tables) == past[-1]
    assert seen(tables, 7) == past[7]  # the version before is kept
    assert sorted(os.listdir(tmp_path / "manifest")) == ["version=7", "version=8"]
    # No bucket is spread over more versions than allowed, and nothing else is left.
    holds = spark.read.parquet(f"{tmp_path}/manifest").groupBy("version", "bucket").count().agg(F.max("count")).first()[0]
    assert holds <= 4
    listed = {(r.bucket, r.holds) for r in spark.read.parquet(f"{tmp_path}/manifest").collect()}
    left = {(r.bucket, r.version) for r in spark.read.parquet(f"{tmp_path}/touched").select("bucket", "version").collect()}
    assert left <= listed


def test_a_broken_commit_is_not_seen_and_can_be_repeated(spark, tmp_path, monkeypatch):
    tables = Versions(spark, str(tmp_path), {"t": "chat_id"}, most_deltas=1)
    state = {1: ["a"], 2: ["b"], 4: ["c"]}
    written(spark, tables, 0, state, {1, 2, 4})
    new = {**state, 1: ["x", "y"], 2: []}

    def crash(self):
        raise RuntimeError("lost")

    # The data of the next version is written, its manifest is not.
    chats = spark.createDataFrame([(1, 1), (2, 2)], "chat_id bigint, bucket int")
    chats.write.partitionBy("bucket").parquet(f"{tmp_path}/touched/version=1")
    spark.createDataFrame([(1, "half", 1)], ROWS).write.partitionBy("bucket").parquet(f"{tmp_path}/t/version=1")
    assert seen(tables) == there(state)
    written(spark, tables, 1, new, {1, 2})
    assert seen(tables) == there(new) and seen(tables, 0) == there(state)
    # A loss after the manifest: the version counts, and clearing up is done by the next one.
    monkeypatch.setattr(Versions, "_retain", crash)
    with pytest.raises(RuntimeError):
        written(spark, tables, 2, {**new, 4: []}, {4})
    monkeypatch.undo()
    assert seen(tables) == there({**new, 4: []})


def test_nothing_touched(spark, tmp_path):
    tables = Versions(spark, str(tmp_path), {"t": "chat_id"})
    written(spark, tables, 0, {5: ["a"]}, {5})
    tables.commit(1, spark.createDataFrame([], "chat_id bigint, bucket int"), {})
    assert seen(tables) == {5: ["a"]} and tables.finished() == 1
    tables.remove("")
    assert tables.finished() == -1 and tables.read("t") is None


def test_offsets(spark):
    """Batches with gaps, late and repeated records: only what was never applied comes through."""
    rnd, done = random.Random(4), set()
    applied = spark.createDataFrame([], OFFSETS)
    spark.conf.set("spark.chatledger.spanWidth", "5")
    try:
        for step in range(6):
            batch = [(rnd.randrange(2), step * 8 + rnd.randint(-30, 9)) for _ in range(12)] + [(0, None)]
            batch = [(p, o if o is None else max(0, o)) for p, o in batch]
            rows = spark.createDataFrame(batch, "partition int, offset bigint")
            fresh = without_applied(rows.distinct(), applied)
            got = {(r.partition, r.offset) for r in fresh.collect()}
            assert got == {b for b in batch if b not in done or b[1] is None}
            done |= {b for b in batch if b[1] is not None}
            merged = [tuple(r) for r in merge_offsets(applied, fresh).collect()]
            assert {(p, o) for p, a, b in merged for o in range(a, b)} == done
            assert len(merged) == sum((p, o - 1) not in done for p, o in done)  # touching ones are joined
            applied = spark.createDataFrame(merged, OFFSETS)
    finally:
        spark.conf.unset("spark.chatledger.spanWidth")
