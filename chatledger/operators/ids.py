"""Handing out ids and restoring the counters after a replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatledger.plans.ordered import SHORT_SPAN, running, total


def assign_ids(commands: DataFrame, base: DataFrame | int = 0, partition: str | None = None) -> DataFrame:
    """Give commands the next ids in order of ``cmd_seq``: one sequence, or one per ``partition`` column.

    ``base`` is the last id used: a number, or a table with ``mark`` (one row, or one per ``partition``).
    """
    keys = [] if partition is None else [partition]
    # The single sequence is walked in spans; per chat this depends on how many commands it has.
    rows = commands.withColumn("hot", F.lit(True)) if partition is None else commands
    rows = running(rows, keys, ["cmd_seq"], width=SHORT_SPAN if partition is None else None, step_=total(F.lit(1)))
    if isinstance(base, int):
        rows = rows.withColumn("mark_", F.lit(base))
    elif keys:
        rows = rows.join(base.select(*keys, F.col("mark").alias("mark_")), keys, "left")
    else:
        rows = rows.withColumn("mark_", base.select("mark").scalar())
    mark = F.coalesce("mark_", F.lit(0))
    return rows.withColumn("new_id", (mark + F.col("step_")).cast("long")).drop("step_", "mark_", "hot")


def chat_id_high_water(chats: DataFrame) -> DataFrame:
    """Where the chat sequence must continue: the largest chat id in use, 0 without chats."""
    return chats.agg(F.coalesce(F.max("id"), F.lit(0)).alias("mark"))


def message_id_high_water(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """Where every chat's message counter must continue: a counter that was never used moves to the
    largest message id of the chat."""
    newest = messages.groupBy("chat_id").agg(F.max("id").alias("max_id"))
    counter = F.col("last_generated_message_id")
    return chats.select(F.col("id").alias("chat_id"), "last_generated_message_id").join(
        newest, "chat_id", "left"
    ).select(
        "chat_id", F.when((counter == 0) & (F.col("max_id") > 0), F.col("max_id")).otherwise(counter).alias("mark")
    )
