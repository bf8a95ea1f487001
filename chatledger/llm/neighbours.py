"""Approximate nearest neighbours with an inverted multi-index.

Vectors are scaled to length one and cut into two halves; each half has its own centroids, so a few hundred centroids
make tens of thousands of cells. A query walks the pairs of centroids by the sum of their distances, with a heap, until
the cells it has passed hold enough vectors, and ranks what they hold by its exact cosine.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatledger.llm.common import cut_lineage

#: Vectors the centroids are fitted on, at most.
SAMPLE = 20_000
#: Vectors to a cell, about, and most centroids of a half: the table of cells has at most their square.
PER_CELL, MOST_CENTROIDS = 8, 256
#: Distinct vectors a query ranks at least, if there are as many, and the share of all that it ranks at least. Vectors
#: without any structure need a large share for a recall of 0.9; clustered ones can do with far less.
CANDIDATES, SHARE = 6_000, 0.4
#: Vectors and queries that meet in one group, about.
BLOCK = 4_096


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def fit(rows: np.ndarray, count: int, rounds: int = 12) -> np.ndarray:
    """Centroids by Lloyd's method from the first rows; a centroid that loses all its rows stays where it is."""
    centres = rows[np.linspace(0, len(rows) - 1, count).astype(int)].copy()
    for _ in range(rounds):
        own = _squared(rows, centres).argmin(1)
        size = np.bincount(own, minlength=count)
        sums = np.stack([np.bincount(own, c, count) for c in rows.T], 1)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def _squared(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres * centres).sum(1) - 2 * rows @ centres.T + (rows * rows).sum(1, keepdims=True)


def walk(first: np.ndarray, second: np.ndarray, held: np.ndarray, enough: int) -> Iterator[tuple[int, int]]:
    """Non-empty cells (i, j) by rising first[i] + second[j], until they hold ``enough``."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, found = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, 0
    while heap and found < enough:
        _, x, y = heapq.heappop(heap)
        i, j = int(a[x]), int(b[y])
        if held[i, j]:
            found += int(held[i, j])
            yield i, j
        for x, y in ((x + 1, y), (x, y + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector of the rows that take part: an id, only finite numbers, not all zero, and as many numbers as
    most rows have (of equally frequent sizes, the largest)."""
    good = embeddings.select("vec_id", F.col("embedding").alias("v")).where(
        "vec_id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and "
        "abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    return good.where(F.size("v") == (top["d"] if top else 0))


def nearest(embeddings: DataFrame, queries: DataFrame, *, k: int = 5, candidates: int = CANDIDATES,
            share: float = SHARE, sample: int = SAMPLE, per_cell: int = PER_CELL) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best found for each vec_id in ``queries``, by cosine, ties to the
    smaller vec_id; a row's own vec_id is not its neighbour. All candidates if there are fewer; no rows for queries that
    take no part (see ``usable``) or for an empty table.

    Equal vectors are one entry of the index with their ``k + 1`` smallest ids, which are all that any answer can name,
    so a vector that fills a third of the table costs no more than any other. Repeated rows count once.
    """
    vectors = usable(embeddings).dropDuplicates(["vec_id", "v"])
    # The engine keeps k + 1 rows of a vector before the shuffle already.
    order = Window.partitionBy("v").orderBy("vec_id")
    firsts = vectors.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    entries = firsts.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = cut_lineage(entries.select(F.element_at("ids", 1).alias("entry"), "v", "ids"))
    asked = cut_lineage(vectors.join(queries.select("vec_id").distinct(), "vec_id").join(
        entries.select("v", "entry"), "v").select("vec_id", "entry"))
    total = entries.count()
    candidates = max(candidates, math.ceil(share * total))
    schema = "entry long, vec_id long, score double"
    if not total:
        empty = entries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        return empty
    drawn = entries.orderBy(F.xxhash64("entry"), "entry").limit(sample).select("v").toArrow()
    rows = _unit(_matrix(drawn.column("v").combine_chunks()))
    half = max(1, rows.shape[1] // 2)
    count = min(MOST_CENTROIDS, len(rows), max(1, math.ceil(math.sqrt(total / per_cell))))
    centres = fit(rows[:, :half], count), fit(rows[:, half:], count) if rows.shape[1] > 1 else np.zeros((count, 0))

    def distances(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        unit = _unit(_matrix(batch.column("v")))
        return _squared(unit[:, :half], centres[0]), _squared(unit[:, half:], centres[1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = [pa.array(d.argmin(1), pa.int32()) for d in distances(batch)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *cell], [*batch.schema.names, "i", "j"])

    placed = cut_lineage(entries.select("entry", "v", "ids").mapInArrow(
        place, "entry long, v array<float>, ids array<long>, i int, j int"
        if entries.schema["v"].dataType.simpleString() == "array<float>"
        else f"entry long, v {entries.schema['v'].dataType.simpleString()}, ids array<long>, i int, j int"))
    held = np.zeros((count, count), np.int64)
    # At most MOST_CENTROIDS squared rows.
    for i, j, n in placed.groupBy("i", "j").count().toArrow().to_pandas().itertuples(index=False):
        held[i, j] = n

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, first, second = batch.column("entry").to_pylist(), *distances(batch)
            row, i, js = [], [], []
            for n in range(len(ids)):
                own: dict[int, list[int]] = {}
                for a, b in walk(first[n], second[n], held, candidates):
                    own.setdefault(a, []).append(b)
                row += [n] * len(own)
                i += own
                js += own.values()
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[n] for n in row], pa.int64()), batch.column("v").take(pa.array(row, pa.int64())),
                 pa.array(i, pa.int32()), pa.array(js, pa.list_(pa.int32()))], ["query", "q", "i", "js"])

    seekers = entries.join(asked.select("entry").distinct(), "entry").select("entry", "v")
    kind = entries.schema["v"].dataType.simpleString()
    visits = cut_lineage(seekers.mapInArrow(visit, f"query long, q {kind}, i int, js array<int>"))
    # Both sides of a crowded centroid are cut into blocks that meet pairwise.
    parts = placed.groupBy("i").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("m")).join(
        visits.groupBy("i").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("s")), "i")
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visits.join(parts, "i").withColumn("y", deal("query", "s")).select("query", "q", "js", "i", "y", every("m").alias("x"))
    right = placed.join(parts, "i").withColumn("x", deal("entry", "m")).select("v", "ids", "j", "i", "x", every("s").alias("y"))

    def rank(seeking: pa.Table, members: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if seeking.num_rows and members.num_rows:
            v, q = (_matrix(t.column(c).combine_chunks()) for t, c in ((members, "v"), (seeking, "q")))
            unit, ids, cell = _unit(v), members.column("ids").to_pylist(), np.asarray(members.column("j"))
            # Of exactly scaled vectors the ones with small ids come first among equal scores.
            order = np.argsort([x[0] for x in ids], kind="stable")
            unit, v, cell, ids = unit[order], v[order], cell[order], [ids[n] for n in order]
            norm = np.sqrt((v * v).sum(1))
            for name, one, js in zip(seeking.column("query").to_pylist(), q, seeking.column("js").to_pylist(), strict=True):
                near = np.flatnonzero(np.isin(cell, js))
                rough = unit[near] @ _unit(one[None])[0]
                if len(near) > k + 1:
                    edge = np.partition(rough, -(k + 1))[-(k + 1)] - 1e-9
                    near = near[rough >= edge]
                score = (v[near] * one).sum(1) / (norm[near] * np.sqrt((one * one).sum()))
                for n, s in sorted(zip(near.tolist(), score.tolist(), strict=True), key=lambda x: (-x[1], x[0]))[: k + 1]:
                    out += [(name, x, s) for x in ids[n]]
        columns = list(zip(*out, strict=True)) or [[]] * 3
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                         pa.array(columns[2], pa.float64())], ["entry", "vec_id", "score"])

    found = left.groupBy("i", "x", "y").cogroup(right.groupBy("i", "x", "y")).applyInArrow(rank, schema)
    best = Window.partitionBy("entry").orderBy(F.desc("score"), "vec_id")
    short = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    answers = asked.withColumnRenamed("vec_id", "query_id").join(short, "entry").where("query_id <> vec_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
