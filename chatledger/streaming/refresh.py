"""Incremental refresh: each micro-batch of the log recomputes only the chats it touches.

The result of every batch equals a full replay of what has arrived. State lives in files of the shared folder:

* ``log/batch=…/bucket=…``: decoded events as they arrived, each record once
* ``dead/batch=…``: records that cannot be applied, with the reason
* ``applied/version=…``: the offsets that have been applied, as intervals per partition
* ``<table>/version=…/bucket=…``: the derived tables (see ``sources.versions``)

A batch writes only folders of its own number, so running it again after a failure replaces its output, and readers see
what the last finished batch left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from chatledger import schemas as S
from chatledger.operators.events import decode, split_known
from chatledger.plans.materialize import cut_lineage
from chatledger.plans.skew import flag_hot
from chatledger.sources.log import dedup, scan_log
from chatledger.sources.log_stream import applied_ends, scan_partitioned
from chatledger.sources.offsets import merge_offsets, without_applied
from chatledger.sources.versions import Versions
from chatledger.streaming.replay import TABLES, replay_full

BUCKETS = 256


def bucket_of(chat: Column, buckets: int = BUCKETS) -> Column:
    """The bucket a chat's rows are kept in."""
    return F.pmod(F.xxhash64(chat), F.lit(buckets)).cast("int")


def _chat_column(table: str) -> str:
    return "id" if table in ("chat_common", "chat_user_view") else "chat_id"


def tables_at(spark: SparkSession, root: str) -> Versions:
    """The versioned tables below ``root``."""
    return Versions(spark, root, {name: _chat_column(name) for name in TABLES})


def apply_batch(
    batch: DataFrame, batch_id: int, root: str, buckets: int = BUCKETS, partitions: int | None = None
) -> None:
    """Store a batch of raw records and bring the tables of the chats in it up to date. ``partitions`` is
    the partition count of a log whose producers stamp no position. Records that an earlier batch applied are left out
    by their offsets, without a look at what was stored."""
    spark, versions = batch.sparkSession, tables_at(batch.sparkSession, root)
    before = versions.applied(batch_id - 1)
    # Decoded once for the events, the dead letters and the offsets.
    fresh = cut_lineage(decode(without_applied(dedup(batch), before), partitions))
    known, dead = split_known(fresh)
    stored = f"{root}/log/batch={batch_id}"
    known.withColumn("bucket", bucket_of(F.col("chat_id"), buckets)).write.mode("overwrite").partitionBy(
        "bucket"
    ).parquet(stored)
    dead.write.mode("overwrite").parquet(f"{root}/dead/batch={batch_id}")
    merge_offsets(before, fresh).write.mode("overwrite").parquet(f"{root}/applied/version={batch_id}")

    log = read_log(spark, root)
    chats = cut_lineage(log.where(F.col("batch") == batch_id).select("chat_id", "bucket").distinct())
    # At most one row per bucket comes to the driver.
    touched = [row.bucket for row in chats.select("bucket").distinct().collect()]
    tables = {}
    if touched:
        log = log.where(F.col("batch") <= batch_id).where(F.col("bucket").isin(touched)).join(
            chats.select("chat_id"), "chat_id", "left_semi")
        tables = replay_full(flag_hot(log.select(*S.EVENT_COLUMNS)))
    versions.commit(batch_id, chats, {
        name: rows.withColumn("bucket", bucket_of(F.col(_chat_column(name)), buckets)) for name, rows in tables.items()})


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """The decoded events that have arrived, with ``batch`` and ``bucket``."""
    layout = T.StructType([*S.EVENT, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])
    return spark.read.schema(layout).parquet(f"{root}/log")


def read_table(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A derived table as of the last finished batch, or as of an earlier one that is still kept."""
    rows = tables_at(spark, root).read(name, version)
    if rows is None:  # no batch has left a table yet
        none = spark.createDataFrame([], S.EVENT).withColumn("hot", F.lit(False))
        return replay_full(none)[name].limit(0)
    return rows


def reset(spark: SparkSession, root: str) -> None:
    """Forget everything below ``root``: tables, stored log and the stream's progress. The next refresh starts from the
    oldest record. No refresh may be running."""
    tables_at(spark, root).remove("")


def start_refresh(
    records: DataFrame, root: str, *, buckets: int = BUCKETS, once: bool = False, partitions: int | None = None
) -> StreamingQuery:
    """Keep the tables below ``root`` fresh from a stream of raw records. ``once`` takes what is there,
    in as many batches as the source makes of it, and stops."""
    writer = records.writeStream.foreachBatch(
        lambda batch, batch_id: apply_batch(batch, batch_id, root, buckets, partitions)
    ).option("checkpointLocation", f"{root}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()


def refresh_available(
    spark: SparkSession, log_path: str, root: str, *, buckets: int = BUCKETS, partitions: int | None = None
) -> None:
    """Process everything the file log holds and wait until it is done."""
    query = start_refresh(scan_log(spark, log_path, stream=True), root, buckets=buckets, once=True, partitions=partitions)
    query.awaitTermination()


def refresh_partitioned(
    spark: SparkSession, log_path: str, root: str, *, ending: dict[int, int] | None = None, buckets: int = BUCKETS,
    partitions: int | None = None,
) -> None:
    """Process a partitioned log by offsets, from where the last run stopped up to ``ending`` (or to what there is), and
    wait until it is done. The tables below ``root`` keep to one kind of source, as the stream's progress does."""
    records = scan_partitioned(spark, log_path, stream=True, ending=ending)
    start_refresh(records, root, buckets=buckets, once=True, partitions=partitions).awaitTermination()


def committed(spark: SparkSession, root: str) -> DataFrame:
    """``partition`` and ``committed`` (the next offset) of what the tables below ``root`` hold, running or not."""
    versions = tables_at(spark, root)
    return applied_ends(versions.applied(versions.finished()))


def wait_until_caught_up(query: StreamingQuery) -> None:
    """Block until a running refresh has processed all records there are."""
    query.processAllAvailable()
