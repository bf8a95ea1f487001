"""The event log as files: scan, bounded scan, append, JSON-lines export and import."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatledger import schemas as S
from chatledger.functions.event_json import strict_box, strict_json
from chatledger.plans.ordered import SHORT_SPAN, numbered, running, total

KAFKA_HEADERS = "array<struct<key: string, value: binary>>"


def scan_log(
    spark: SparkSession, path: str, *, end_offsets: DataFrame | None = None, stream: bool = False
) -> DataFrame:
    """Raw records of a file log from the oldest one on, as a batch or a stream.

    With ``end_offsets`` (partition, end_offset) the scan stops before each partition's end;
    partitions without records or without an end are left out.
    """
    reader = spark.readStream if stream else spark.read
    records = reader.schema(S.RECORD).parquet(path)
    return records if end_offsets is None else bounded(records, end_offsets)


def scan_kafka(
    spark: SparkSession, servers: str, topic: str, *, stream: bool = False, ending: str = "latest"
) -> DataFrame:
    """The same records from a broker, where the public Kafka connector is deployed."""
    reader = (spark.readStream if stream else spark.read).format("kafka")
    reader = reader.option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    reader = reader.option("startingOffsets", "earliest").option("includeHeaders", "true")
    if not stream:
        reader = reader.option("endingOffsets", ending)
    return from_kafka_layout(reader.load())


def from_kafka_layout(rows: DataFrame) -> DataFrame:
    """Kafka source columns (binary key and value, header array) as raw records."""
    headers = F.map_from_entries(F.transform(
        "headers", lambda h: F.struct(h["key"].alias("key"), h["value"].cast("string").alias("value"))
    ))
    return rows.select(
        "partition", "offset", F.col("key").cast("string").alias("key"), headers.alias("headers"),
        F.col("value").cast("string").alias("value"),
    )


def end_offsets(records: DataFrame) -> DataFrame:
    """Each partition's end: one past its newest offset. One row per partition."""
    return records.groupBy("partition").agg((F.max("offset") + 1).alias("end_offset"))


def bounded(records: DataFrame, ends: DataFrame) -> DataFrame:
    """Records before the snapshot of end offsets; a partition whose end is 0 has none."""
    ends = ends.where("end_offset > 0")
    return records.join(F.broadcast(ends), "partition").where("offset < end_offset").drop("end_offset")


def log_position(headers: str = "headers", partitions: int | None = None) -> Column:
    """The position of a record: the producer's stamp, or (offset, partition) where there is none."""
    stamp = F.col(headers)["log_seq"].try_cast("bigint")
    if partitions is None:
        return stamp
    return F.coalesce(stamp, F.col("offset") * partitions + F.col("partition"))


def hash_partition(key: Column, partitions: int) -> Column:
    """The partition of a key: a fixed hash of its text."""
    return F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int")


def remainder_partition(key: Column, partitions: int) -> Column:
    """The partition of a numeric key: its remainder."""
    return F.pmod(key.cast("bigint"), F.lit(partitions)).cast("int")


def append_log(
    events: DataFrame, partitions: int, *, first_offsets: DataFrame | None = None,
    partitioner: Callable[[Column, int], Column] = hash_partition,
) -> DataFrame:
    """Give events keyed by chat their partition and offset, in order of ``log_seq``.

    The key alone picks the partition, so a chat never spreads over two. ``first_offsets``
    (partition, end_offset) continues an existing log. The few partitions hold all rows, so each of them
    is walked in spans.
    """
    placed = events.withColumn("key", F.col("chat_id").cast("string"))
    placed = placed.withColumn("partition", partitioner(F.col("key"), partitions)).withColumn("hot", F.lit(True))
    numbered = running(placed, ["partition"], ["log_seq"], width=SHORT_SPAN, place=total(F.lit(1)))
    start = F.lit(0)
    if first_offsets is not None:
        numbered = numbered.join(F.broadcast(first_offsets), "partition", "left")
        start = F.coalesce("end_offset", F.lit(0))
    return numbered.withColumn("offset", F.col("place") - 1 + start).drop("place", "hot", "end_offset")


def partition_balance(events: DataFrame) -> DataFrame:
    """Chats and events per partition, and chats found in more than one partition (always 0)."""
    spread = events.groupBy("chat_id").agg(
        F.count_distinct("partition").alias("parts"), F.min("partition").alias("partition"), F.count(F.lit(1)).alias("n")
    )
    return spread.groupBy("partition").agg(
        F.count(F.lit(1)).alias("chats"), F.sum("n").alias("events"),
        F.count_if(F.col("parts") > 1).alias("split_chats"),
    )


def export_log(records: DataFrame) -> DataFrame:
    """One JSON line per record, whole and in (partition, offset) order within each file.

    The value is parsed and written as JSON again, so a value that is not JSON stops the export.
    """
    bad = F.concat(F.lit("cannot export a value that is not JSON: "), F.col("value"))
    # The partition id keeps the filter above the parsing, which it would repeat.
    parsed = records.withColumn("json_", F.when(F.spark_partition_id() >= 0, strict_json("value")))
    # In a filter, the check runs whatever columns are read later.
    sound = parsed.where(F.when(F.col("json_").isNotNull(), True).otherwise(F.raise_error(bad).cast("boolean")))
    line = F.to_json(F.struct(
        F.struct("offset", "partition").alias("metadata"), "headers", "key", F.col("json_").alias("value"),
    ))
    return sound.select("partition", "offset", line.alias("value"))


def write_export(records: DataFrame, path: str) -> None:
    """Export to text files, cut by log order so that any number of tasks writes in parallel. Records are dealt before
    they are parsed: finding the cuts reads what is dealt once more."""
    dealt = records.repartitionByRange("partition", "offset").sortWithinPartitions("partition", "offset")
    export_log(dealt).select("value").write.mode("errorifexists").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of an export with their file and line number; there is no limit on their length. Numbering is one
    distributed sort of the lines by their place, which the import needs for their order anyway."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_"),
        F.monotonically_increasing_id().alias("read_"),
    )
    return numbered(lines, ["file"], [F.col("block_"), F.col("read_")], "line").drop("block_", "read_")


# Reasons an import line is refused.
NOT_JSON = "line is not JSON"
BAD_KEY = "key is not a string"
BAD_PARTITION = "partition is not an integer"
BAD_HEADER = "header value is not a string"


def validate_lines(lines: DataFrame) -> DataFrame:
    """Judge export lines (column ``value``): adds the parsed fields, ``ok`` and ``reason``.

    The checks run in a fixed order; the first that fails names the reason.
    """
    # The partition id keeps filters on the verdict above the parsing, which they would repeat for every field.
    parsed = lines.withColumn("doc_", F.when(F.spark_partition_id() >= 0, strict_box("value")))
    headers = F.expr("try_variant_get(doc_, '$[0].headers', 'map<string, variant>')")
    parsed = parsed.withColumn("headers_", headers)
    is_text = lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))
    key = F.expr("try_variant_get(doc_, '$[0].key', 'variant')")
    partition = F.expr("try_variant_get(doc_, '$[0].metadata.partition', 'variant')")
    number = F.expr("try_variant_get(doc_, '$[0].metadata.partition', 'string')")
    bad_header = F.exists(F.map_values("headers_"), lambda v: ~is_text(v))
    integer = F.coalesce(F.schema_of_variant(partition) == "BIGINT", F.lit(False)) & number.try_cast("int").isNotNull()
    reason = (
        F.when(F.col("doc_").isNull(), NOT_JSON)
        .when(~is_text(key), BAD_KEY)
        .when(~integer, BAD_PARTITION)
        .when(F.coalesce(bad_header, F.lit(False)), BAD_HEADER)
    )
    return parsed.select(
        *lines.columns,
        reason.isNull().alias("ok"), reason.alias("reason"),
        number.try_cast("int").alias("partition_"),
        F.expr("try_variant_get(doc_, '$[0].metadata.offset', 'bigint')").alias("offset_"),
        F.expr("try_variant_get(doc_, '$[0].key', 'string')").alias("key_"),
        F.transform_values("headers_", lambda _, v: F.try_variant_get(v, "$", "string")).alias("headers_"),
        F.expr("to_json(try_variant_get(doc_, '$[0].value', 'variant'))").alias("value_"),
    )


def import_log(lines: DataFrame, *, strict: bool = True) -> DataFrame:
    """Rebuild records from export lines, with the offsets they had (null where a line has none). ``strict`` stops at
    the first bad line with its number, reason and text, whatever is read of the result; otherwise bad lines are left
    out (``rejected_lines`` lists them). ``import_append`` gives new offsets."""
    judged = validate_lines(lines)
    if strict:
        where = F.concat(F.lit(" "), F.col("line").cast("string")) if "line" in lines.columns else F.lit("")
        message = F.concat(F.lit("cannot import line"), where, F.lit(" ("), F.col("reason"), F.lit("): "), F.col("value"))
        # In a filter, the check runs whatever columns are read later.
        judged = judged.where(F.when(F.col("ok"), True).otherwise(F.raise_error(message).cast("boolean")))
    places = [c for c in ("file", "line") if c in lines.columns]
    return judged.where(F.lit(True) if strict else F.col("ok")).select(
        F.col("partition_").alias("partition"), F.col("offset_").alias("offset"),
        F.col("key_").alias("key"), F.col("headers_").alias("headers"), F.col("value_").alias("value"), *places,
    )


def import_append(lines: DataFrame, log: DataFrame, *, strict: bool = True) -> DataFrame:
    """Records of export lines to be appended to ``log`` (raw records, maybe none): each partition goes on where the log
    ends, in order of file and line, whatever offsets the lines name. Stamped positions move behind the log's."""
    records = import_log(lines, strict=strict)
    placed = numbered(records, ["partition"], [F.col("file"), F.col("line")], "place_")
    placed = placed.join(F.broadcast(end_offsets(log)), "partition", "left")
    last = log.agg(F.coalesce(F.max(log_position()), F.lit(-1)).alias("last")).scalar()
    stamp = log_position()
    moved = F.map_concat(
        F.map_filter("headers", lambda k, _: k != "log_seq"), F.create_map(F.lit("log_seq"), (stamp + last + 1).cast("string"))
    )
    return placed.select(
        "partition", (F.coalesce("end_offset", F.lit(0)) + F.col("place_") - 1).alias("offset"), "key",
        F.when(stamp.isNull(), F.col("headers")).otherwise(moved).alias("headers"), "value",
    )


def rejected_lines(lines: DataFrame) -> DataFrame:
    """The dead letters of an import: refused lines with the reason."""
    return validate_lines(lines).where(~F.col("ok")).select(*lines.columns, "reason")


def dedup(records: DataFrame) -> DataFrame:
    """Drop redelivered records. Copies are reduced before the shuffle, so many copies of one record
    do not pile up in a task. Records without an offset cannot be told apart and stay.

    The offsets alone are counted first; without copies the records themselves are never shuffled."""
    placed = records.where("offset is not null")
    if placed.groupBy("partition", "offset").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return records
    return placed.dropDuplicates(["partition", "offset"]).unionByName(records.where("offset is null"))
