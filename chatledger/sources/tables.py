"""The decoded log stored as tables laid out by chat: ordinary chats in buckets, hot ones ranged by position."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatledger.operators.events import read_events
from chatledger.plans.materialize import scratch_path
from chatledger.plans.skew import find_hot

# Events to a bucket, at most; no chat of a bucket is hot.
ROWS_PER_BUCKET = 1 << 22

Folded = DataFrame | dict[str, DataFrame]


@dataclass(frozen=True)
class Parts:
    """The stored log in two parts that share no chat, each with the column ``hot`` as a literal.

    ``cold`` is bucketed and sorted by chat, so work per chat needs no shuffle there. ``hot`` is ranged by chat and
    position over evenly filled files, as one bucket would have to hold its largest chat whole; without hot chats it is
    None.
    """

    cold: DataFrame
    hot: DataFrame | None

    def events(self) -> DataFrame:
        """All events, for work that is not per chat. A union has no layout of its own."""
        return self.cold if self.hot is None else self.cold.unionByName(self.hot)

    def per_chat(self, fold: Callable[[DataFrame], Folded]) -> Folded:
        """``fold(events())`` for a fold that never looks from one chat at another: each part is folded for itself and
        keeps its layout, and one hot chat does not make the ordinary ones shuffle. A fold gives one table or several
        by name."""
        cold = fold(self.cold)
        if self.hot is None:
            return cold
        hot = fold(self.hot)
        if isinstance(cold, dict):
            return {name: table.unionByName(hot[name]) for name, table in cold.items()}
        return cold.unionByName(hot)


def store_records(records: DataFrame, partitions: int | None = None, path: str | None = None) -> tuple[Parts, DataFrame]:
    """A log's records as the stored events and the dead letters: redelivered records counted once, broken values out."""
    known, dead = read_events(records, partitions)
    return store_parts(known, path), dead


def store_events(events: DataFrame, path: str | None = None, *, buckets: int | None = None) -> DataFrame:
    """``store_parts`` as one table."""
    return store_parts(events, path, buckets=buckets).events()


def store_parts(events: DataFrame, path: str | None = None, *, buckets: int | None = None) -> Parts:
    """Write decoded events below ``path`` by chat, ordinary and hot chats apart, and read them back. Events without a
    chat are ordinary ones. An empty log gives an empty cold part."""
    spark = events.sparkSession
    path = path or scratch_path(spark, "events")
    staged = scratch_path(spark, "staged")
    events.write.parquet(staged)
    cold = rows = spark.read.schema(events.schema).parquet(staged)
    hot, listed = None, find_hot(rows)
    if listed is not None:
        ids = F.broadcast(listed)  # at most MAX_HOT ids
        cold = rows.join(ids, "chat_id", "left_anti").select(*rows.columns)
        spread = rows.join(ids, "chat_id", "left_semi").select(*rows.columns).repartitionByRange("chat_id", "log_seq")
        spread.sortWithinPartitions("chat_id", "log_seq").write.parquet(f"{path}/hot")
        hot = spark.read.schema(rows.schema).parquet(f"{path}/hot").withColumn("hot", F.lit(True))
    # One task reads and sorts a bucket, so their number follows the rows.
    wanted = max(spark.sparkContext.defaultParallelism, -(-cold.count() // ROWS_PER_BUCKET))
    count = buckets or int(spark.conf.get("spark.chatledger.buckets", str(wanted)))
    table = f"events_{uuid.uuid4().hex}"
    (
        cold.repartition(count, "chat_id").write.bucketBy(count, "chat_id").sortBy("chat_id", "log_seq")
        .option("path", f"{path}/cold").format("parquet").saveAsTable(table)
    )
    return Parts(spark.table(table).withColumn("hot", F.lit(False)), hot)
