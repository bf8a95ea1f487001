"""How far a consumer is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the committed offset of a partition without a commit.
NO_COMMIT = -1


def consumer_lag(ends: DataFrame, committed: DataFrame) -> DataFrame:
    """Per partition: end, committed offset (-1 when there is none) and the records left."""
    return ends.join(committed, "partition", "left").select(
        "partition", "end_offset", F.coalesce("committed", F.lit(NO_COMMIT)).alias("committed")
    ).withColumn("lag", F.col("end_offset") - F.greatest("committed", F.lit(0)))


def is_caught_up(lag: DataFrame) -> DataFrame:
    """One boolean: nothing was ever written, or some partition is committed and all committed ones are
    at their end. Partitions without a commit do not count."""
    commits = F.col("committed") != NO_COMMIT
    done = F.bool_and(F.when(commits, F.col("committed") == F.col("end_offset")))
    return lag.agg(
        (F.coalesce(F.bool_and(F.col("end_offset") == 0), F.lit(True)) | F.coalesce(done, F.lit(False)))
        .alias("caught_up")
    )
