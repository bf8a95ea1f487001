"""Ordered passes over the log that hold when one key owns a large share of all rows.

Rows of a key are taken in order of a position. For ordinary keys a pass is one window. Rows of a hot
chat are cut into spans of log positions: a window runs inside each span, the spans are reduced to one
row each, a second window over these rows gives what every span inherits, and a join adds it. No task
ever orders more than one span of a hot chat, and the result is the same as that of one long window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatledger.plans.materialize import cut_lineage, growing
from chatledger.plans.skew import span_of


# Positions to a span where a few keys, as the partitions of a log, hold all rows: their spans are all the tasks there are.
SHORT_SPAN = 1 << 18


@dataclass(frozen=True)
class Pass:
    """One output column of an ordered pass: what to carry along and of which expression."""

    kind: str
    value: Column


def last(value: Column) -> Pass:
    """Latest non-null value up to and including the row."""
    return Pass("last", value)


def previous(value: Column) -> Pass:
    """Latest non-null value strictly before the row."""
    return Pass("previous", value)


def following(value: Column) -> Pass:
    """Value of the next row; it must not be null on any row."""
    return Pass("following", value)


def highest(value: Column) -> Pass:
    """Largest value up to and including the row."""
    return Pass("highest", value)


def total(value: Column) -> Pass:
    """Sum up to and including the row."""
    return Pass("total", value)


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], *, reverse: bool = False, width: int | None = None,
    **passes: Pass,
) -> DataFrame:
    """Add the columns of ``passes`` to ``df``, which must have the boolean column ``hot``.

    ``order`` starts with the log position; further columns break ties. ``reverse`` walks backwards. ``width`` is the
    most positions of a span, if that is to be less than usual.
    """
    keys, order = list(keys), list(order)
    forward = (lambda c: F.col(c).desc()) if reverse else (lambda c: F.col(c).asc())
    backward = (lambda c: F.col(c).asc()) if reverse else (lambda c: F.col(c).desc())
    rank = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    newest, oldest = (F.min_by, F.max_by) if reverse else (F.max_by, F.min_by)

    df = df.withColumn("span_", span_of(df.sparkSession, order[0], width))
    inside = Window.partitionBy(*keys, "hot", "span_").orderBy(*[forward(c) for c in order])
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    spans = Window.partitionBy(*keys).orderBy(forward("span_")).rowsBetween(Window.unboundedPreceding, -1)
    spans_back = Window.partitionBy(*keys).orderBy(backward("span_")).rowsBetween(Window.unboundedPreceding, -1)

    local, reduced, carried, merged = {}, [], [], {}
    for name, step in passes.items():
        here, kept, brought = F.col(f"{name}_here"), f"{name}_kept", f"{name}_brought"
        value = step.value
        if step.kind in ("last", "previous"):
            local[f"{name}_here"] = F.last(value, ignorenulls=True).over(upto if step.kind == "last" else before)
            reduced.append(newest(value, F.when(value.isNotNull(), rank)).alias(kept))
            carried.append(F.last(kept, ignorenulls=True).over(spans).alias(brought))
            merged[name] = F.coalesce(here, F.col(brought))
        elif step.kind == "following":
            local[f"{name}_here"] = F.lead(value, 1).over(inside)
            reduced.append(oldest(value, rank).alias(kept))
            carried.append(F.last(kept, ignorenulls=True).over(spans_back).alias(brought))
            merged[name] = F.coalesce(here, F.col(brought))
        elif step.kind == "highest":
            local[f"{name}_here"] = F.max(value).over(upto)
            reduced.append(F.max(value).alias(kept))
            carried.append(F.max(kept).over(spans).alias(brought))
            merged[name] = F.greatest(here, F.col(brought))
        else:
            local[f"{name}_here"] = F.sum(value).over(upto)
            reduced.append(F.sum(value).alias(kept))
            carried.append(F.sum(kept).over(spans).alias(brought))
            merged[name] = F.coalesce(here, F.lit(0)) + F.coalesce(F.col(brought), F.lit(0))

    inherited = (
        df.where("hot").groupBy(*keys, "span_").agg(*reduced).select(*keys, "span_", *carried)
    )
    joined = df.withColumns(local).join(inherited, [*keys, "span_"], "left")
    outputs = [column.alias(name) for name, column in merged.items()]
    return joined.select(*[c for c in df.columns if c != "span_" and c not in merged], *outputs)


def as_of(
    probes: DataFrame, facts: DataFrame, keys: Sequence[str], probe_at: str, fact_at: str,
    payload: Sequence[str], *, reverse: bool = False, width: int | None = None,
) -> DataFrame:
    """Add to each probe the payload of the nearest fact at or before its position (at or after it
    with ``reverse``). Both sides are walked in one ordered pass; there is no join on a range."""
    columns = probes.columns
    extra = [c for c in columns if c not in keys and c != "hot"]
    values = F.struct(*[F.col(c) for c in payload])
    nulls = [F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in extra]
    line = facts.select(
        *keys, "hot", F.col(fact_at).alias("at_"), F.lit(reverse).alias("late_"), values.alias("fact_"), *nulls
    ).withColumn("probe_", F.lit(False)).unionByName(
        probes.select(
            *keys, "hot", F.col(probe_at).alias("at_"), F.lit(not reverse).alias("late_"), *extra
        ).withColumn("probe_", F.lit(True)), allowMissingColumns=True,
    )
    walked = running(line, keys, ["at_", "late_"], reverse=reverse, width=width, found_=last(F.col("fact_")))
    return walked.where("probe_").select(*columns, *[F.col(f"found_.{c}").alias(c) for c in payload])


# Starts of keys and blocks that ``numbered`` sends to the rows, at most.
MAX_STARTS = 10_000


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "pos") -> DataFrame:
    """Number the rows of each key 1, 2, … in the given order, which must be total.

    One distributed sort places the rows; each sorted block is counted, and a row's number is its place
    in the block plus the rows of the key in earlier blocks. A key of any size is spread over as many
    tasks as the sort gives it. The sorted rows are stored, so both readers see the same blocks.
    """
    keys = list(keys)
    placed = cut_lineage(df.orderBy(*keys, *order).withColumn("place_", F.monotonically_increasing_id()))
    placed = placed.withColumn("block_", F.shiftright("place_", 33))
    blocks = placed.groupBy(*keys, "block_").agg(
        F.count(F.lit(1)).alias("rows_"), F.min("place_").alias("first_")
    )
    # One row per key and sorted block that holds it: keys plus blocks in all.
    earlier = Window.partitionBy(*keys).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        *keys, "block_", "first_", F.coalesce(F.sum("rows_").over(earlier), F.lit(0)).alias("before_")
    )
    starts = cut_lineage(starts)
    # With few of them, as for the files of an import, the rows themselves need no other shuffle than the sort's.
    few = starts.limit(MAX_STARTS + 1).count() <= MAX_STARTS
    starts = F.broadcast(starts) if few else growing(starts)
    number = F.col("place_") - F.col("first_") + F.col("before_") + 1
    return placed.join(starts, [*keys, "block_"]).select(*df.columns, number.alias(name))
