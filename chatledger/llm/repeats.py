"""Windows of text that start at more than one place, found by routing text to the one shard that can tell.

The anchor of a window is the smallest hash among its runs of ``gram`` units (words or bytes). Equal windows have equal
anchors, and neighbouring windows mostly share theirs, so a document falls into segments: stretches of windows with one
anchor. Only segments whose anchor occurs twice can hold a repeated window. Of these each distinct one is fetched once,
with the number of its occurrences, and sent to the shard of its anchor, where a searcher decides which of its windows
occur twice. Both searchers, suffix automata over words and merged Burrows-Wheeler transforms over bytes, see all
occurrences of a window in one place and never more of the corpus than one shard.

Texts are told apart by a 64-bit hash and their size, segments by two 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatledger.llm.common import cut_lineage, flat_text, slices, stored
from chatledger.llm.hashing import byte_codes, find_words, grams, run_hash, sums, word_codes

#: An anchor with more distinct segments than this is not sent to a shard: its windows are counted one by one.
HOT = 4096

#: bodies and weights of the segments of a shard -> per segment, the first and last (exclusive) starts of repeated windows
Search = Callable[[list[bytes], np.ndarray, int], list[list[tuple[int, int]]]]


@dataclass(frozen=True)
class Kind:
    """What a window is made of: ``length`` words or bytes, with anchors of ``gram`` of them."""

    words: bool
    length: int
    gram: int

    def units(self, part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the units of texts lying one after the other, their byte ranges, and the units before each text."""
        if self.words:
            starts, ends, before = find_words(part, at)
            return word_codes(part, starts, ends), starts, ends, before
        place = np.arange(len(part))
        return byte_codes(part), place, place + 1, at


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbours."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def segments(codes: np.ndarray, before: np.ndarray, kind: Kind) -> tuple[np.ndarray, ...]:
    """anchor, digest, text, first unit, units and whether the anchor lies in it twice, of every segment."""
    running, length, width = sums(codes), kind.length, kind.length - kind.gram + 1
    if len(codes) < length:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, bool))
    runs = grams(running, kind.gram)
    low = sliding_min(runs, width)
    sizes = np.diff(before)
    ends = np.repeat(before[1:], sizes)[: len(low)]
    valid = np.arange(len(low)) + length <= ends
    changes = low[1:] != low[:-1]
    first = valid.copy()
    first[1:] &= changes | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= changes | ~valid[1:]
    a, e = np.flatnonzero(first), np.flatnonzero(last)
    anchor = low[a]
    reach = np.arange(width)
    left = (runs[a[:, None] + reach] == anchor[:, None]).argmax(1) + a
    right = width - 1 - (runs[e[:, None] + reach[::-1]] == anchor[:, None]).argmax(1) + e
    text = np.searchsorted(before, a, "right") - 1
    return anchor, run_hash(running, a, e + length), text, a - before[text], e + length - a, left != right


def _key(documents: DataFrame) -> DataFrame:
    """doc_id and text, with the text's hash and size."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(
        "doc_id", text.alias("text"), F.xxhash64(text).alias("t"), F.octet_length(text).cast("long").alias("z"))


def _rows(keyed: DataFrame, kind: Kind) -> DataFrame:
    """anchor, seg, t, z, at: every segment of every text. ``at`` packs first unit, units and the twice mark."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = flat_text(batch.column("text"))
            t, z = batch.column("t").to_numpy(), batch.column("z").to_numpy()
            for first, last in slices(offsets, 1 << 20):
                part = flat[offsets[first] : offsets[last]]
                codes, _, _, before = kind.units(part, offsets[first : last + 1] - offsets[first])
                anchor, seg, text, start, size, twice = segments(codes, before, kind)
                at = (start << 32) | (size << 1) | twice
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(t[first + text]),
                     pa.array(z[first + text]), pa.array(at)], ["anchor", "seg", "t", "z", "at"])

    return keyed.where(F.col("z") >= kind.length).select("text", "t", "z").mapInArrow(
        cut, "anchor long, seg long, t long, z long, at long")


def _fetch(keyed: DataFrame, wanted: DataFrame, kind: Kind) -> DataFrame:
    """anchor, seg, n and the body (UTF-8 bytes) of each wanted segment, read from one row of its text."""
    rows = keyed.groupBy("t", "z").agg(F.min("doc_id").alias("id_"))
    lists = wanted.groupBy("t", "z").agg(F.collect_list(F.struct("anchor", "seg", "n", "at")).alias("found"))
    lists = lists.join(rows, ["t", "z"]).withColumnsRenamed({"t": "t_", "z": "z_"})
    same = keyed["doc_id"].eqNullSafe(lists["id_"]) & (keyed["t"] == lists["t_"]) & (keyed["z"] == lists["z_"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = flat_text(batch.column("text"))
            found = batch.column("found")
            values, rows = found.flatten(), np.diff(np.asarray(found.offsets))
            own = {c: np.asarray(values.field(c)) for c in ("anchor", "seg", "n", "at")}
            owner, bodies = np.repeat(np.arange(len(rows)), rows), []
            for i, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                part = flat[lo:hi]
                _, starts, ends, _ = kind.units(part, np.array([0, hi - lo]))
                data = part.tobytes()
                for at in own["at"][owner == i] if rows[i] else ():
                    a = int(at) >> 32
                    bodies.append(data[starts[a] : ends[a + ((int(at) & 0xFFFFFFFF) >> 1) - 1]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(own["anchor"]), pa.array(own["seg"]), pa.array(own["n"]), pa.array(bodies, pa.binary())],
                ["anchor", "seg", "n", "body"])

    # The lists are small next to the texts, which are shuffled by text, so copies of a text stay spread by doc_id.
    return keyed.join(lists, same).select("text", "found").mapInArrow(
        read, "anchor long, seg long, n long, body binary")


def _split(body: bytes, kind: Kind) -> list[bytes]:
    return body.split() if kind.words else [body[i : i + 1] for i in range(len(body))]


def _counted(bodies: DataFrame, kind: Kind) -> DataFrame:
    """The verdict for segments of hot anchors: every window by its digest, counted over all of them."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, seg, n, body in zip(*(batch.column(c).to_pylist() for c in ("anchor", "seg", "n", "body")),
                                            strict=True):
                units = _split(body, kind)
                glue = b" " if kind.words else b""
                digests = [hashlib.md5(glue.join(units[i : i + kind.length])).digest()
                           for i in range(len(units) - kind.length + 1)]
                size = len(digests)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([anchor] * size, pa.int64()), pa.array([seg] * size, pa.int64()),
                     pa.array([n] * size, pa.int64()), pa.array(range(size), pa.int32()),
                     pa.array(digests, pa.binary())], ["anchor", "seg", "n", "i", "w"])

    rows = bodies.mapInArrow(windows, "anchor long, seg long, n long, i int, w binary")
    twice = rows.groupBy("w").agg(F.sum("n").alias("c")).where("c > 1").select("w")
    hit = rows.join(twice, "w").groupBy("anchor", "seg").agg(F.array_sort(F.collect_set("i")).alias("i"))
    return hit.select("anchor", "seg", F.flatten(F.transform("i", lambda i: F.array(i, i + 1))).alias("spans"))


def repeated_spans(documents: DataFrame, kind: Kind, search: Search, *, per_shard: int, hot: int = HOT) -> DataFrame:
    """t, z and spans (first unit and one past the last, flat, by start) of what repeated windows cover, for every text
    that has any. ``per_shard`` units go to a shard, about."""
    keyed = _key(documents)
    rows = _rows(keyed, kind)
    twice = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.max(F.col("at") % 2).alias("m"))
    twice = cut_lineage(twice.where("c > 1 or m = 1").select("anchor"))
    # Copies of a text give equal rows; they are counted before anything else happens to them.
    kept = stored(rows.join(twice, "anchor", "left_semi").groupBy("anchor", "seg", "t", "z", "at").agg(
        F.count(F.lit(1)).alias("n")), "segments")
    wanted = stored(kept.groupBy("anchor", "seg").agg(
        F.sum("n").alias("n"), F.min(F.struct("t", "z", "at")).alias("r")
    ).select("anchor", "seg", "n", "r.t", "r.z", "r.at"), "wanted")
    units = wanted.agg(F.sum(F.expr("(at & 4294967295) div 2"))).first()[0] or 0
    shards = max(1, -(-int(units) // per_shard))
    crowded = cut_lineage(wanted.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot).select("anchor"))
    bodies = _fetch(keyed, wanted, kind)
    some_crowded = not crowded.isEmpty()
    # Both ways read the same shuffled texts.
    calm = bodies.join(crowded, "anchor", "left_anti") if some_crowded else bodies

    def decide(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks()
        anchor, seg = shard.column("anchor").to_numpy(), shard.column("seg").to_numpy()
        _, one = np.unique(np.stack([anchor, seg], 1), axis=0, return_index=True)  # rows repeated as a whole
        body, weight = shard.column("body").to_pylist(), shard.column("n").to_numpy()
        found = search([body[i] for i in one], weight[one], kind.length)
        hit = [i for i, spans in enumerate(found) if spans]
        return pa.table({
            "anchor": anchor[one][hit], "seg": seg[one][hit],
            "spans": pa.array([[x for s in found[i] for x in s] for i in hit], pa.list_(pa.int32()))})

    sent = calm.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    verdict = sent.groupBy("shard").applyInArrow(decide, "anchor long, seg long, spans array<int>")
    if some_crowded:
        verdict = verdict.unionByName(_counted(bodies.join(crowded, "anchor", "left_semi"), kind))
    verdict = cut_lineage(verdict)
    first = F.shiftright("at", 32).cast("int")
    covers = kept.join(verdict, ["anchor", "seg"]).select("t", "z", F.transform(
        "spans", lambda x, i: x + first + F.when(i % 2 == 1, kind.length - 1).otherwise(0)).alias("spans"))
    return covers.groupBy("t", "z").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merged(spans: np.ndarray, units: int) -> np.ndarray:
    """Which of a text's units the flat spans cover."""
    edges = np.zeros(units + 1, np.int64)
    np.add.at(edges, np.minimum(spans[0::2], units), 1)
    np.add.at(edges, np.minimum(spans[1::2], units), -1)
    return np.cumsum(edges)[:-1] > 0


def remove(documents: DataFrame, spans: DataFrame, kind: Kind) -> DataFrame:
    """Every row with its units, those removed, the maximal runs of them, the digest of what is left and, as bytes, what
    is left: words joined by one space, or bytes."""
    # Copies of one text may be many: the join on it is one that the engine splits by itself.
    joined = _key(documents).join(spans, ["t", "z"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = flat_text(batch.column("text"))
            found, out = batch.column("spans"), []
            for i, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                own, part = found[i].as_py() if found[i].is_valid else None, flat[lo:hi]
                if kind.words:
                    _, starts, ends, _ = kind.units(part, np.array([0, hi - lo]))
                    units = len(starts)
                else:
                    units = hi - lo
                gone = merged(np.array(own, np.int64), units) if own else np.zeros(units, bool)
                data = part.tobytes()
                if kind.words:
                    words = data.split()
                    left = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if own else words)
                else:
                    left = part[~gone].tobytes() if own else data
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((units, int(gone.sum()), runs, hashlib.sha256(left).hexdigest(), left))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
                ["doc_id", "n_units", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind_id = documents.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "text", "spans").mapInArrow(
        run, f"doc_id {kind_id}, n_units long, n_removed long, n_spans long, kept_sha256 string, kept binary")
