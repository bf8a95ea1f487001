"""Mixing sources to target weights over a tree of domains, languages and sources.

The token budget flows from the root to the leaves by weight. A node cannot take more than its documents give in
``most_epochs`` passes; what it cannot take goes to its siblings by their weights, and reaches the other children of
an ancestor only if no sibling has room: the capacity of a node is the sum of its children's, so a node's share falls
only when all below it are full. Each leaf then takes whole passes over its documents and, of one more pass in
seeded order, the longest prefix that fits.

All amounts are whole tokens, so the same rows come out of any engine.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatledger.llm.common import cut_lineage, free_name, row_key, words

#: The levels of the tree, from the root's children to the leaves.
LEVELS = ("domain", "language", "source")
#: Weights of named children; others have weight ``OTHER``. Weights are compared among siblings only.
WEIGHTS = {"language": {"en": 4, "de": 2, "fr": 2, "es": 2}, "domain": {"d0": 3, "d1": 2}, "source": {}}
OTHER = 1
#: Sources are grouped into domains by their number: so many to a domain.
PER_DOMAIN = 5


def place(documents: DataFrame, row: str | None = None) -> DataFrame:
    """Each document's place in the tree and its tokens (words). Null languages and sources are children named '';
    sources without a number at their end are in domain ''. The column ``row`` is kept."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]{1,9})$", 1)
    domain = F.when(number == "", "").otherwise(
        F.concat(F.lit("d"), F.floor(F.try_divide(number.try_cast("bigint"), F.lit(PER_DOMAIN))).cast("string")))
    return documents.select(
        "doc_id", *[row] * (row is not None), domain.alias("domain"),
        F.coalesce("lang", F.lit("")).alias("language"), F.coalesce("source", F.lit("")).alias("source"), F.size(words("text")).cast("long").alias("tokens"))


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    named = weights.get(level) or {}
    out = F.lit(OTHER)
    for name, weight in named.items():
        out = F.when(F.col(level) == name, weight).otherwise(out)
    return out.cast("long")


def budget(leaves: DataFrame, tokens: int, most_epochs: int, weights: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """``target`` of every leaf. ``leaves`` has one row per leaf with its ``size``; its rows are as many as the tree
    has leaves, however many documents there are."""
    given = leaves.withColumn("given", F.lit(tokens).cast("long"))
    for depth, level in enumerate(LEVELS):
        parent, node = LEVELS[:depth], LEVELS[: depth + 1]
        nodes = given.groupBy(*node).agg(
            (F.sum("size") * most_epochs).alias("room"), F.first("given").alias("given")
        ).withColumn("weight", _weight(level, weights))
        # Children fill up in the order of room per weight.
        order = Window.partitionBy(*parent).orderBy((F.col("room") / F.col("weight")), level)
        upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        family = Window.partitionBy(*parent)
        filled = nodes.withColumn("room_upto", F.sum("room").over(upto)).withColumn(
            "weight_after", F.sum("weight").over(family) - F.sum("weight").over(upto))
        full = F.col("room") * F.col("weight_after") <= (F.col("given") - F.col("room_upto")) * F.col("weight")
        filled = filled.withColumn("full", full)
        rest = F.col("given") - F.sum(F.when(F.col("full"), F.col("room")).otherwise(0)).over(family)
        open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(family)
        filled = filled.withColumn("rest", rest).withColumn("open_weight", open_weight)
        share = F.when(F.col("full"), F.col("room")).otherwise(F.expr("(weight * rest) div open_weight"))
        shares = filled.select(*node, F.least(F.col("room"), share).alias("given"))
        given = leaves.select(*LEVELS, "size").join(shares, list(node))
    return given.withColumnRenamed("given", "target")


def mix(
    documents: DataFrame, *, share: int = 80, most_epochs: int = 4, seed: int = 1,
    weights: Mapping[str, Mapping[str, int]] = WEIGHTS, digits: int = 3, row: str | None = None,
) -> DataFrame:
    """``copies`` of every document in a mix of ``share`` percent of all tokens.

    A leaf's target gives ``target / size`` whole passes; the next pass is ordered by a hash of seed, pass and doc_id
    and cut after the last document that still fits. The order is summed in two steps, per range of the hash's first
    ``digits`` digits and within a range, so no task orders a whole leaf. Repeated rows count each for itself,
    ordered among themselves by size; documents without words take no tokens and ride along with each pass.
    An empty table gives an empty result; columns other than doc_id, text, lang and source are not read, but for ``row``,
    which names one that tells rows with equal doc_ids apart and is handed on.
    """
    docs = cut_lineage(place(documents, row))
    leaves = docs.groupBy(*LEVELS).agg(F.sum("tokens").alias("size"))
    total = docs.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    targets = budget(leaves, total * share // 100, most_epochs, weights).select(
        *LEVELS, "target", F.expr("target div nullif(size, 0)").alias("passes"),
        F.expr("target % nullif(size, 0)").alias("left_over"))
    targets = cut_lineage(targets.na.fill(0, ["passes", "left_over"]))
    key = F.md5(F.concat_ws("|", F.lit(seed), "passes", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = docs.join(targets, list(LEVELS)).withColumn("key", key).withColumn("range", F.substring("key", 1, digits))
    ranges = keyed.groupBy(*LEVELS, "range").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(*LEVELS, "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = [row] * (row is not None)
    within = Window.partitionBy(*LEVELS, "range").orderBy("key", "tokens", *own).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ended = keyed.join(starts, [*LEVELS, "range"]).withColumn("end", F.col("start") + F.sum("tokens").over(within))
    return ended.select(
        "doc_id", *own, *LEVELS, "tokens", "target",
        (F.col("passes") + F.when(F.col("end") <= F.col("left_over"), 1).otherwise(0)).alias("copies"))


def repeat(documents: DataFrame, **settings: object) -> DataFrame:
    """The mix itself: every document as often as ``mix`` says, with all columns of ``documents``.

    Rows are told apart by 128 bits over all columns, so null and reused doc_ids are no matter; of equal rows one is
    given as often as all of them together. Columns may have any names.
    """
    columns = documents.columns
    row, wanted, place_, copy = (free_name(columns, c) for c in ("row_", "id_", "place_", "copy_"))
    count = free_name(columns, "n_")
    keyed = documents.withColumn(row, row_key(documents))
    per_row = mix(keyed, row=row, **settings).groupBy(F.col(row).alias(wanted)).agg(
        F.sum("copies").cast("int").alias(count))
    picked = keyed.join(per_row.where(F.col(count) > 0), F.col(row) == F.col(wanted)).withColumn(
        place_, F.row_number().over(Window.partitionBy(row).orderBy(wanted))).where(F.col(place_) == 1)
    return picked.select(*columns, F.explode(F.array_repeat(F.lit(0), F.col(count))).alias(copy)).select(*columns)


def oracle(share: int = 80, most_epochs: int = 4, seed: int = 1) -> str:
    """The same in SQL, with the default weights."""
    def weight(level: str) -> str:
        named = WEIGHTS[level]
        cases = " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in named.items())
        return f"CASE {cases} ELSE {OTHER} END" if cases else str(OTHER)

    steps, given = [], f"SELECT *, (SELECT coalesce(sum(tokens), 0) FROM d) * {share} // 100 AS given FROM leaves"
    for depth, level in enumerate(LEVELS):
        parent, node = ", ".join(LEVELS[:depth]), ", ".join(LEVELS[: depth + 1])
        by = f"PARTITION BY {parent} " if parent else ""
        steps += [
            f"g{depth} AS ({given})",
            f"n{depth} AS (SELECT {node}, CAST(sum(size) * {most_epochs} AS BIGINT) AS room, "
            f"CAST(any_value(given) AS BIGINT) AS given, CAST({weight(level)} AS BIGINT) AS weight "
            f"FROM g{depth} GROUP BY {node})",
            f"w{depth} AS (SELECT *, sum(room) OVER w AS room_upto, sum(weight) OVER ({by}) - sum(weight) OVER w AS "
            f"weight_after FROM n{depth} WINDOW w AS ({by}ORDER BY room / weight, {level} ROWS UNBOUNDED PRECEDING))",
            f"f{depth} AS (SELECT *, room * weight_after <= (given - room_upto) * weight AS is_full FROM w{depth})",
            f"r{depth} AS (SELECT *, given - sum(CASE WHEN is_full THEN room ELSE 0 END) OVER ({by}) AS rest, "
            f"sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({by}) AS open_weight FROM f{depth})",
            f"s{depth} AS (SELECT {node}, least(room, CASE WHEN is_full THEN room ELSE (weight * rest) // open_weight "
            f"END) AS given FROM r{depth})",
        ]
        given = f"SELECT l.*, s.given FROM leaves l JOIN s{depth} s USING ({node})"
    levels = ", ".join(LEVELS)
    return f"""
    WITH d AS (
      SELECT doc_id, CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN ''
        ELSE 'd' || CAST(CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) // {PER_DOMAIN} AS VARCHAR) END
        AS domain, coalesce(lang, '') AS language, coalesce(source, '') AS source,
        CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT)
        AS tokens FROM documents),
    leaves AS (SELECT {levels}, sum(tokens) AS size FROM d GROUP BY {levels}),
    {", ".join(steps)},
    t AS (SELECT {levels}, CAST(given AS BIGINT) AS target,
      CAST(coalesce(given // nullif(size, 0), 0) AS BIGINT) AS passes,
      coalesce(given % nullif(size, 0), 0) AS left_over FROM ({given})),
    k AS (SELECT *, md5(concat_ws('|', {seed}, passes, coalesce(CAST(doc_id AS VARCHAR), ''))) AS key
      FROM d JOIN t USING ({levels})),
    e AS (SELECT *, sum(tokens) OVER (PARTITION BY {levels} ORDER BY key, tokens ROWS UNBOUNDED PRECEDING) AS ends
      FROM k)
    SELECT doc_id, {levels}, tokens, target,
      passes + CASE WHEN ends <= left_over THEN 1 ELSE 0 END AS copies FROM e"""
