"""Digests of tables, to compare them without moving their rows.

A row's digest is 128 bits over all its columns, and digests add up: a bucket of rows has the sum of theirs. Equal tables
have equal digests in whatever order and layout they come, and a row that occurs twice counts twice. Rows are dealt to
buckets by their keys, so a changed row is missing and extra in one bucket. Tables are compared from few buckets to
many, and only buckets that differ are looked into; what is shuffled are digests, never texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatledger.plans.materialize import cut_lineage

#: Bits of the bucket number, from the first comparison to the last. 2**16 numbers at most are ever broadcast.
LEVELS = (8, 16)
_PARTS, _MODULUS = ("p0", "p1", "p2", "p3"), 1 << 32


def _text(name: str, kind: str) -> Column:
    """A column as text that says where it ends and whether it is null."""
    column = F.col(name)
    if kind == "map":
        column = F.array_sort(F.map_entries(column))
    plain = F.to_json(F.struct(column.alias("v"))) if kind in ("map", "array", "struct") else column.cast("string")
    return F.when(F.col(name).isNull(), "n").otherwise(
        F.concat(F.char_length(plain).cast("string"), F.lit(":"), plain))


def row_digest(table: DataFrame) -> Column:
    """The digest of a row: columns by name, whatever their order; whole numbers of any width are the same."""
    kinds = {f.name: f.dataType.typeName() for f in table.schema.fields}
    return F.md5(F.concat(F.lit(""), *[_text(name, kinds[name]) for name in sorted(kinds)]))


def _bucket(table: DataFrame, keys: Sequence[str], bits: int) -> Column:
    keyed = table.select(*keys)
    return F.conv(F.substring(row_digest(keyed), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit((1 << bits) - 1))


def _sums() -> list[Column]:
    """Per group of rows with the column ``digest``: how many, and their sum in four parts of 32 bits each."""
    parts = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    return [F.count("digest").alias("n"),
            *[F.coalesce(F.pmod(F.sum(p), F.lit(_MODULUS)), F.lit(0)).alias(name)
              for p, name in zip(parts, _PARTS, strict=True)]]


def table_digest(table: DataFrame, **sums: Column) -> DataFrame:
    """One row: ``rows`` and ``digest`` of a whole table (32 hex digits; of an empty one, zeros), and the ``sums`` of
    further expressions, 0 if there is nothing to add.

    Partial sums are taken per bucket first, so that none passes 63 bits before 2**31 rows share a bucket.
    """
    own = table.select(row_digest(table).alias("digest"), *[value.alias(name) for name, value in sums.items()])
    leaves = own.groupBy(F.substring("digest", 30, 3).alias("bucket")).agg(
        *_sums(), *[F.sum(name).alias(name) for name in sums])
    return leaves.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.concat(*[F.format_string("%08x", F.coalesce(F.pmod(F.sum(p), F.lit(_MODULUS)), F.lit(0)))
                   for p in _PARTS]).alias("digest"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in sums])


def _sided(left: DataFrame, right: DataFrame, keys: Sequence[str], within: tuple[int, DataFrame] | None) -> DataFrame:
    """bucket (of the last level), digest and side of both tables' rows, if asked for only those in some buckets."""
    out = None
    for side, table in ((1, left), (-1, right)):
        rows = table.select(_bucket(table, keys, LEVELS[-1]).alias("bucket"), row_digest(table).alias("digest"),
                            F.lit(side).alias("side"))
        if within is not None:
            rows = _only(rows, within)
        out = rows if out is None else out.unionByName(rows)
    return out


def _only(rows: DataFrame, within: tuple[int, DataFrame]) -> DataFrame:
    """The rows whose bucket is among those of a coarser level."""
    bits, buckets = within
    own = rows.withColumn("node", F.col("bucket").bitwiseAND(F.lit((1 << bits) - 1)))
    return own.join(F.broadcast(buckets), "node", "left_semi").drop("node")


def differing(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[int, DataFrame] | None:
    """The buckets of the last level in which two tables differ, with the bits of their numbers; None if they are equal.

    Either table is read once a level, and its buckets' digests, as many as the level has at most, are all that moves.
    """
    within = None
    for bits in LEVELS:
        node = F.col("bucket").bitwiseAND(F.lit((1 << bits) - 1)).alias("node")
        sums = _sided(left, right, keys, within).groupBy(node, "side").agg(*_sums())
        apart = sums.groupBy("node").agg(*[F.sum(F.col(c) * F.col("side")).alias(c) for c in ("n", *_PARTS)])
        unequal = F.lit(False)
        for c in ("n", *_PARTS):
            unequal = unequal | (F.col(c) != 0)
        found = cut_lineage(apart.where(unequal).select("node"))
        if found.isEmpty():
            return None
        within = bits, found
    return within


def changed(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """``digest`` of every row that one table has more often than the other, and ``n``: how often more the left has it
    (negative: the right). None if the tables are equal."""
    within = differing(left, right, keys)
    if within is None:
        return None
    return _sided(left, right, keys, within).groupBy("digest").agg(F.sum("side").alias("n")).where("n <> 0")


def changed_rows(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows themselves, each as often as it is surplus, with ``side``: 'left' or 'right'. Only these are fetched.

    Columns called ``side``, ``digest`` or ``n`` stop it with an error, as does a table without the other's columns.
    """
    if {"side", "digest", "n"} & {c.lower() for c in left.columns}:
        raise ValueError("a table to compare has no columns side, digest or n")
    right = right.select(*left.columns)
    found, out = changed(left, right, keys), None
    for side, table, sign in (("left", left, 1), ("right", right, -1)):
        if found is None:
            surplus = table.limit(0)
        else:
            own = table.withColumn("digest", row_digest(table)).join(found.where(F.col("n") * sign > 0), "digest")
            # Equal rows are one; the surplus says how many of them.
            one = own.dropDuplicates(["digest"]).withColumn("n", F.explode(F.sequence(F.lit(1), F.abs("n").cast("int"))))
            surplus = one.select(*table.columns)
        surplus = surplus.withColumn("side", F.lit(side))
        out = surplus if out is None else out.unionByName(surplus)
    return out
