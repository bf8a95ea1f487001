"""Near duplicates with MinHash bands and odd sketches.

Equal shingle sets are one class from the start. Classes that share a band of MinHash values are candidates. Every
class also folds its MinHash samples into a bitmap of parities, an odd sketch: the ones in the exclusive or of two
sketches tell how many samples differ, most exactly where the sets are most alike. Candidates that pass the sketch are
confirmed on their whole sets.

A band may hold any number of classes, so pairs are not listed. First all classes of a band are compared with its most
central class, which joins most of them in linear work. Bands that still hold several components are then searched,
block against block, and only confirmed links between different components leave the task.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatledger.llm.common import cut_lineage, flat_text, odd_bytes, slices
from chatledger.llm.components import components
from chatledger.llm.hashing import find_words, grams, lower, mix, sums, word_codes
from chatledger.plans.materialize import scratch_path

BANDS, ROWS, SKETCH_BITS = 25, 5, 512
#: Sketches that say this much less than the threshold still pass: over four standard errors of the samples.
MARGIN = 0.15
#: Classes of a band that one task compares with as many others at once.
BLOCK = 2048
#: Pairs that read one copy of a central text.
PER_COPY = 50_000

_FACTORS, _SHIFTS = odd_bytes(21, BANDS * ROWS), odd_bytes(22, BANDS * ROWS)
_SAMPLE_CODES, _BAND_CODES = odd_bytes(23, BANDS * ROWS), odd_bytes(24, BANDS)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Per text, the sorted hashes of its distinct shingles. A text with fewer words than ``size`` is one shingle, a
    text without words has none."""
    flat, offsets = flat_text(column)
    for first, last in slices(offsets, 1 << 20):
        at = offsets[first : last + 1] - offsets[first]
        part = lower(flat[offsets[first] : offsets[last]])
        starts, ends, before = find_words(part, at)
        codes = word_codes(part, starts, ends)
        running = sums(codes)
        full = grams(running, size)
        for i in range(last - first):
            a, b = before[i], before[i + 1]
            if b - a >= size:
                yield np.unique(full[a : b - size + 1])
            elif b > a:
                yield mix(sums(codes[a:b])[-1:] + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def signature(found: np.ndarray) -> np.ndarray:
    """The MinHash samples of a non-empty set."""
    low = np.full(len(_FACTORS), 2**64 - 1, np.uint64)
    for i in range(0, len(found), 1024):
        part = found[i : i + 1024]
        low = np.minimum(low, (part[None] * _FACTORS[:, None] + _SHIFTS[:, None]).min(1))
    return mix(low)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """The samples as a bitmap of parities, in eight 64-bit words."""
    place = (mix(samples ^ _SAMPLE_CODES) % np.uint64(SKETCH_BITS)).astype(np.int64)
    bits = (np.bincount(place, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.uint64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One key per band."""
    rows = samples.reshape(BANDS, ROWS)
    out = _BAND_CODES.copy()
    for i in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return out


def most_different_bits(threshold: float) -> int:
    """The most ones in the exclusive or of two sketches that may still be as similar as ``threshold``."""
    differ = 2 * len(_FACTORS) * (1 - max(0.0, threshold - MARGIN))
    return math.ceil(SKETCH_BITS / 2 * (1 - math.exp(-2 * differ / SKETCH_BITS)))


def sketches(documents: DataFrame, size: int) -> DataFrame:
    """doc_id, n (set size), s1 and s2 (digest of the set), bands and odd, for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s1, s2, bands, odd = [], [], [], [], []
            for found in shingle_sets(batch.column("text"), size):
                n.append(len(found))
                s1.append(int(found.sum(dtype=np.uint64).view(np.int64)))
                s2.append(int(mix(found ^ _CODES_2).sum(dtype=np.uint64).view(np.int64)))
                samples = signature(found) if len(found) else None
                bands.append(None if samples is None else band_keys(samples).view(np.int64))
                odd.append(None if samples is None else odd_sketch(samples).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(s1, pa.int64()),
                 pa.array(s2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))],
                ["doc_id", "n", "s1", "s2", "bands", "odd"])

    return documents.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n long, s1 long, s2 long, bands array<long>, odd array<long>")


_CODES_2 = np.uint64(0xD6E8FEB86659FD93)


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share at least ``percent`` of their union."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)) or not len(x):
        return False
    place = np.minimum(np.searchsorted(x, y), len(x) - 1)
    shared = int((x[place] == y).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. ``texts`` is bucketed by node and is not shuffled; only the
    text of ``b`` travels, one copy for up to ``PER_COPY`` pairs, so a central text is not one task's burden."""
    many = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("c"))
    salted = pairs.join(many, "b").select(
        "a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("c") / PER_COPY)).alias("salt"))
    copies = salted.select("b", "salt").distinct().join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")
    both = salted.join(copies, ["b", "salt"]).join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = shingle_sets(batch.column("text_a"), size), shingle_sets(batch.column("text_b"), size)
            keep = [_similar(x, y, percent) for x, y in zip(left, right, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def _alike(a: str, b: str, most: int) -> F.Column:
    """Whether two sketches (arrays of longs) are close enough."""
    ones = [F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(SKETCH_BITS // 64)]
    return sum(ones[1:], ones[0]) <= most


def _blocks(members: DataFrame, size: int, percent: int) -> DataFrame:
    """The confirmed links (a, b) between different components within a band. A band of m blocks is compared in
    m(m+1)/2 groups; a task holds two blocks at a time. A pair is judged in the first band that it shares, on its
    sketches and then on its whole sets, unless earlier links of the group have joined the two already."""
    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = dealt.select("*", met).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component",
        "odd", "bands", "text")
    most = most_different_bits(percent / 100)

    def links(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        col = lambda c: rows.column(c).to_numpy()
        flat = lambda c, n: rows.column(c).combine_chunks().flatten().to_numpy().reshape(-1, n)
        key, i, j, own, node, comp = map(col, ("key", "i", "j", "own", "node", "component"))
        words, bands = flat("odd", SKETCH_BITS // 64).view(np.uint64), flat("bands", BANDS)
        texts, sets, joined = rows.column("text").combine_chunks(), {}, {}
        found: list[tuple[int, int]] = []

        def shingles(row: int) -> np.ndarray:
            if row not in sets:
                sets[row] = next(shingle_sets(texts.slice(row, 1), size))
            return sets[row]

        def top(label: int) -> int:
            while label in joined:
                label = joined[label]
            return label

        for step in range(1, len(key)):
            here = np.flatnonzero((key[step:] == key[:-step]) & (i[step:] == i[:-step]) & (j[step:] == j[:-step]))
            if not len(here):
                break
            there = here + step
            open_ = (comp[here] != comp[there]) & ((own[here] != own[there]) | (i[here] == j[here]))
            here, there = here[open_], there[open_]
            near = np.bitwise_count(words[here] ^ words[there]).sum(1) <= most
            here, there = here[near], there[near]
            first = (bands[here] == bands[there]).argmax(1)
            mine = bands[here, first] == key[here]
            for x, y in zip(here[mine].tolist(), there[mine].tolist(), strict=True):
                a, b = top(comp[x]), top(comp[y])
                if a != b and _similar(shingles(x), shingles(y), percent):
                    joined[max(a, b)] = min(a, b)
                    found.append((max(node[x], node[y]), min(node[x], node[y])))
        ends = list(zip(*found, strict=True)) or [[], []]
        return pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in ends], ["a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            edge = rows.num_rows
            group = [np.asarray(rows.column(c)) for c in ("key", "i", "j")]
            while edge and all(c[edge - 1] == c[-1] for c in group):
                edge -= 1
            if edge:
                yield links(rows.slice(0, edge))
            held = rows.slice(edge)
        if held is not None and held.num_rows:
            yield links(held)

    grouped = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return grouped.mapInArrow(search, "a long, b long").distinct()


def near_duplicates(documents: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and n_links (confirmed links found while joining) for every row.

    Documents link when their sets of ``size``-word shingles share at least ``percent`` of their union. Rows with one
    doc_id are one node, linked through any of their texts. Null and empty texts have no shingles and no links. Rows
    without doc_id belong to the smallest doc_id with an equal set, else to no component (null, kept). A link right
    at the threshold is missed about once in 100,000 times at 85 percent, in 20,000 at 80, and more rarely above it;
    links are never reported without the exact check.
    """
    most = most_different_bits(percent / 100)
    signed = cut_lineage(sketches(documents, size))
    classes = signed.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("node"))
    named = cut_lineage(signed.select("doc_id", "s1", "s2", "n").join(classes, ["s1", "s2", "n"], "left"))
    firsts = named.where("doc_id = node").select("s1", "s2", "n", "node").distinct()
    shapes = signed.where("n > 0").join(
        firsts, (signed["doc_id"] == firsts["node"]) & (signed["s1"] == firsts["s1"]) & (signed["s2"] == firsts["s2"])
    ).select("node", "bands", "odd")
    keyed = shapes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    members = cut_lineage(keyed.join(shared, "key"))
    weights = members.groupBy("node").agg(F.sum("c").alias("weight"))
    odd = cut_lineage(weights.join(shapes.select("node", "odd", "bands").distinct(), "node"))
    # Rows with one doc_id but different sets are one node.
    ids = named.where("node is not null and doc_id is not null")
    split = ids.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("b < top")
    links = cut_lineage(ids.join(split, "doc_id").select(F.col("node").alias("a"), "b").where("a <> b"))

    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spark, name = documents.sparkSession, f"near_{uuid.uuid4().hex}"
    wanted = documents.select(F.col("doc_id").cast("long").alias("node"), "text").join(
        odd.select("node").distinct(), "node")
    (wanted.repartition(parts, "node").write.bucketBy(parts, "node").sortBy("node")
     .option("path", scratch_path(spark, "near")).format("parquet").saveAsTable(name))
    confirm = partial(_confirm, texts=spark.table(name), size=size, percent=percent)
    # Every class of a band against its most central one.
    seats = members.select("key", "node").join(odd.select("node", "weight", "odd"), "node")
    best = F.max_by(F.struct("node", "odd"), F.struct("weight", "node")).alias("centre")
    met = seats.join(seats.groupBy("key").agg(best), "key").select(
        F.col("node").alias("a"), F.col("centre.node").alias("b"), "odd", F.col("centre.odd").alias("odd_b"))
    tried = met.where((F.col("a") != F.col("b")) & _alike("odd", "odd_b", most)).select("a", "b").distinct()
    links = cut_lineage(links.unionByName(confirm(tried).distinct()))
    component = cut_lineage(components(links))
    rest = members.select("key", "node").join(odd.select("node", "odd", "bands"), "node")
    rest = rest.join(component, "node", "left").withColumn("component", F.coalesce("component", F.col("node")))
    mixed = rest.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    rest = rest.join(mixed.select("key"), "key").join(spark.table(name), "node")
    links = cut_lineage(links.unionByName(_blocks(rest, size, percent)))
    component = cut_lineage(components(links))
    spark.sql(f"DROP TABLE {name}")

    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(
        F.count(F.lit(1)).alias("n_links"))
    out = named.join(component, "node", "left").join(degree, "node", "left")
    found = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "node"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), found.alias("component_id"),
        F.col("doc_id").eqNullSafe(found).alias("kept"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
