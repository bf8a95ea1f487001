"""Finding chats that hold too many rows for one task.

Rows are weighed by the work they make: an event counts once and once more for every user it lists, since most
operators fan it out to them. A chat is *hot* when it weighs at least ``max(hotRows, total / MAX_HOT)``. By counting, no more than
``MAX_HOT`` chats can be hot, so the list of hot chats has a fixed size bound and may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatledger.plans.materialize import cut_lineage

MAX_HOT = 100_000


def hot_rows(spark: SparkSession) -> int:
    """Rows a single ordered group may hold before its chat is split."""
    return int(spark.conf.get("spark.chatledger.hotRows", str(1 << 22)))


def span_width(spark: SparkSession) -> int:
    """Log positions per span of a hot chat: the most rows one window group of it can hold."""
    return int(spark.conf.get("spark.chatledger.spanWidth", str(1 << 22)))


def hot_chats(rows: DataFrame) -> DataFrame:
    """Chats over the threshold (at most ``MAX_HOT``); rows are pre-aggregated before the shuffle."""
    listed = F.greatest(F.coalesce(F.size("participant_ids"), F.lit(0)), F.lit(0)) if "participant_ids" in rows.columns else F.lit(0)
    counts = rows.groupBy("chat_id").agg(F.sum(1 + listed).alias("n"))
    share = counts.agg((F.sum("n") / MAX_HOT).alias("share")).scalar()
    floor = F.lit(hot_rows(rows.sparkSession))
    return counts.where(F.col("n") >= F.greatest(floor, share)).select("chat_id")


def find_hot(rows: DataFrame) -> DataFrame | None:
    """The stored list of hot chats, or None when there is none (one small job)."""
    hot = cut_lineage(hot_chats(rows))
    return None if hot.isEmpty() else hot


def mark_hot(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Add the boolean column ``hot``. Without hot chats it is a literal, and every branch that
    handles hot chats is folded away by the optimizer."""
    if hot is None:
        return rows.withColumn("hot", F.lit(False))
    listed = F.broadcast(hot.withColumn("hot", F.lit(True)))  # at most MAX_HOT ids
    return rows.join(listed, "chat_id", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))


def flag_hot(rows: DataFrame) -> DataFrame:
    """``mark_hot`` with the rows' own hot chats."""
    return mark_hot(rows, find_hot(rows))


def inherit_hot(rows: DataFrame, events: DataFrame) -> DataFrame:
    """``rows`` split like the log: hot where the log's chat is (at most ``MAX_HOT`` ids)."""
    hot = events.where("hot").select("chat_id", F.lit(True).alias("hot")).distinct()
    return rows.join(F.broadcast(hot), "chat_id", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))


def align_hot(rows: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` and the log flagged alike: hot where a chat is hot in either. Rows of both kinds meet in
    one ordered pass, so they must agree on how a chat is split."""
    rows = inherit_hot(rows, events)
    own = find_hot(rows)
    if own is None:
        return rows, events
    listed = F.broadcast(own.withColumn("own_", F.lit(True)))  # at most MAX_HOT ids
    either = F.col("hot") | F.coalesce("own_", F.lit(False))
    return tuple(
        side.join(listed, "chat_id", "left").withColumn("hot", either).drop("own_") for side in (rows, events)
    )


def span_of(spark: SparkSession, position: str, width: int | None = None) -> Column:
    """The span of a row: a slice of log positions for hot chats, one single span for all others. ``width`` is the most
    positions of a slice, if that is to be less than ``span_width``."""
    slice_ = span_width(spark) if width is None else min(width, span_width(spark))
    return F.when(F.col("hot"), F.expr(f"{position} div {slice_}")).otherwise(F.lit(0).cast("long"))
