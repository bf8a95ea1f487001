"""Connected components of a graph that no machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatledger.llm.common import cut_lineage

#: Edges to a task, about, and the fewest tasks of a step.
PER_TASK, FEW_TASKS = 50_000, 8


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (its smallest node) for every node of ``edges`` (a, b: long).

    Alternates two steps until nothing changes: every node ties its larger neighbours to its smallest one, then itself
    and its smaller neighbours to that. Rounds grow with the logarithm of the size. Self-loops, repeated and empty
    edges are fine. Work of a round is joins on a node; hot nodes are split by the engine's skew join.
    """
    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))

    now = cut_lineage(edges.where("a <> b").select("a", "b").distinct())
    # A task takes about so many edges: a small graph is not spread over as many tasks as the rows it came from.
    tasks = max(FEW_TASKS, now.count() // PER_TASK)
    now = now.coalesce(tasks)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(smallest(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.coalesce(tasks).distinct().coalesce(tasks).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        joined = down.join(smallest(down), "a")
        small = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        now = cut_lineage(small.where("a <> b").coalesce(tasks).distinct().coalesce(tasks))
        # Done when every node points to one other, and nothing points on from there.
        ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")),
                                            F.struct(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))).alias("e"))
        degrees = ends.groupBy("e.node").agg(F.sum("e.out").alias("out"), F.max("e.in").alias("in"))
        if degrees.where("out > 1 or out = 1 and in = 1").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(ends.select(F.col("component").alias("node"), "component").distinct())
