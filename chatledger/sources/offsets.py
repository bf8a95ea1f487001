"""Which offsets of each partition have been applied, as intervals ``[from_offset, to_offset)``.

A log is applied nearly in order, so a partition has one long interval and a few more where offsets are missing. A record
that comes again is told by its offset alone, however long ago it was applied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatledger.plans.ordered import SHORT_SPAN, as_of, highest, previous, running, total


def without_applied(records: DataFrame, applied: DataFrame) -> DataFrame:
    """The records whose offset lies in no applied interval. Records without an offset cannot be told apart and stay."""
    placed = records.where("offset is not null").withColumn("hot", F.lit(True))
    found = as_of(placed, applied.withColumn("hot", F.lit(True)), ["partition"], "offset", "from_offset", ["to_offset"],
                  width=SHORT_SPAN)
    fresh = found.where("to_offset is null or offset >= to_offset").select(*records.columns)
    return fresh.unionByName(records.where("offset is null"))


def merge_offsets(applied: DataFrame, records: DataFrame) -> DataFrame:
    """The intervals with the offsets of more records; intervals that touch become one."""
    more = records.where("offset is not null").select(
        "partition", F.col("offset").alias("from_offset"), (F.col("offset") + 1).alias("to_offset"))
    line = applied.select("partition", "from_offset", "to_offset").unionByName(more).withColumn("hot", F.lit(True))
    # A partition holds very many offsets, so it is walked in spans of them.
    line = running(line, ["partition"], ["from_offset", "to_offset"], width=SHORT_SPAN, reach=highest(F.col("to_offset")))
    line = running(line, ["partition"], ["from_offset", "to_offset"], width=SHORT_SPAN, before=previous(F.col("reach")))
    begins = F.col("before").isNull() | (F.col("from_offset") > F.col("before"))
    line = running(line, ["partition"], ["from_offset", "to_offset"], width=SHORT_SPAN, run=total(begins.cast("int")))
    return line.groupBy("partition", "run").agg(
        F.min("from_offset").alias("from_offset"), F.max("to_offset").alias("to_offset")).drop("run")
